"""``python -m keyloom.cli -I in1 in2 -O out``: sort files of 100-byte records."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from keyloom.operators.output import MEGABYTE
from keyloom.plans.file_sort import sort_files


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-I", "--input", nargs="+", required=True, action="extend", help="input folders or files")
    p.add_argument("-O", "--output", required=True)
    p.add_argument("--out-file-size", type=int, default=128, help="largest output file, in MB of 10^6 bytes")
    p.add_argument("--ranges", type=int, help="key ranges; default: one for each core or output file")
    p.add_argument("--sample", choices=["spread", "head"], default="spread")
    p.add_argument("--strict", action="store_true", help="fail on a trailing partial record instead of dropping it")
    p.add_argument("--overwrite", action="store_true", help="replace what the output folder holds; else it must be empty")
    p.add_argument("--working", help="shared folder for checkpoints")
    p.add_argument("--threads", type=int, help="tasks side by side, in a session of this process")
    p.add_argument("--verbose", action="store_true", help="log what is read, dropped and written")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING)
    builder = SparkSession.builder.appName("keyloom sort")
    if a.threads:
        builder = builder.master(f"local[{a.threads}]")
    if a.working:
        builder = builder.config("spark.checkpoint.dir", a.working)
    done = sort_files(builder.getOrCreate(), a.input, a.output, a.out_file_size * MEGABYTE, a.ranges, a.strict, a.sample, a.overwrite)
    if done.dropped:
        logging.getLogger("keyloom").warning("%d bytes of trailing partial records were dropped", done.dropped)
    print(done)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
