"""The whole sort: record files in, size-capped partition.<n> files in global order out."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.records import KEY_LEN, MAX_KEY, RECORD_LEN
from keyloom.operators import output, partitioning, sampling
from keyloom.sources import storage
from keyloom.sources.fixed_record import read_records, register

#: More ends than this are looked up in a sorted array instead of a tree of comparisons.
TREE_ENDS = 256
#: A range is the unit of work of the last step; beyond so many, ranges become larger and write several files.
MAX_RANGES, SAMPLES_A_RANGE = 50_000, 20


@dataclass(frozen=True)
class SortResult:
    records: int
    files: int
    ranges: int
    dropped: int = 0  # bytes of trailing partial records


def record_ends(sample: DataFrame, parts: int) -> list[bytes]:
    """Ends that cut the sampled records (key, value) into even ranges, then MAX_KEY.

    Equal records are one row with their number. An end is a key; where a key is so frequent that
    several ends share it, they are whole records, so its rows are split by value.
    """
    rows = sample.groupBy("key", "value").agg(F.count("*").alias("n")).toArrow()  # bounded by the sample
    if not rows.num_rows or parts < 2:
        return [MAX_KEY]
    found = sorted(zip((k + v for k, v in zip(rows["key"].to_pylist(), rows["value"].to_pylist())), rows["n"].to_pylist()))
    upto = np.cumsum([n for _, n in found])
    at = np.searchsorted(upto, [int(upto[-1]) * i // parts for i in range(1, parts)], side="right")
    ends = [found[i][0] for i in np.minimum(at, len(found) - 1)]
    keys = [e[:KEY_LEN] for e in ends]
    hot = {k for k, nxt in zip(keys, keys[1:]) if k == nxt}
    return [e if k in hot else k for e, k in zip(ends, keys)] + [MAX_KEY]


def sort_files(spark: SparkSession, inputs: list[str], out: str, cap: int = output.DEFAULT_CAP, ranges: int | None = None, strict: bool = False, sample: str = "spread", overwrite: bool = False) -> SortResult:
    """Sort all records of ``inputs`` to ``out``, which must hold no files, unless it is to be overwritten.

    The number of records is known from the files' sizes. Ranges come from a sample of records; counts by
    range give every range's first file number before anything is written. Rows cross the network once, to the task of
    their range, and are sorted there with spilling. Rows of one frequent key are dealt to several ranges by
    their values. No files or no records give no output. ``sample="head"`` takes the head of the first file only.
    """
    per_file = output.records_per_file(cap)
    register(spark)
    files = storage.data_files(inputs)
    total, dropped = sum(size // RECORD_LEN for _, size in files), sum(size % RECORD_LEN for _, size in files)
    if storage.listed(out) and not overwrite:
        raise FileExistsError(f"{out} is not empty")
    if not total:
        if dropped and strict:
            raise ValueError("the input has no whole record")
        return SortResult(0, 0, 0, dropped)
    paths = [path for path, _ in files]
    records = read_records(spark, paths, strict)
    if ranges is None:
        ranges = min(MAX_RANGES, max(spark.sparkContext.defaultParallelism, -(-total // per_file)))
    if sample == "head":
        picked = read_records(spark, [next(path for path, size in files if size >= RECORD_LEN)], strict).limit(sampling.HEAD_RECORDS)
    else:
        picked = sampling.spread(records, max(20_000, SAMPLES_A_RANGE * ranges), ("key", "value"), total=total)
    ends = record_ends(picked, ranges)
    by = "key" if all(len(e) <= KEY_LEN + 1 for e in ends) else "_record"
    if by == "_record":
        records = records.withColumn(by, F.concat("key", "value"))
    if len(ends) <= TREE_ENDS:
        assigned = records.withColumn("pid", partitioning.assign(records[by], ends))
    else:
        assigned = partitioning.assign_many(records, ends, by)
    planned = output.files_by_range(partitioning.sizes(assigned.select("pid"), ranges), per_file).orderBy("pid").collect()  # one row a range
    n_files, n_records = sum(r["files"] for r in planned), sum(r["n"] for r in planned)
    bases = ",".join(str(r["base"]) for r in planned)
    ordered = partitioning.exchange(assigned.select("key", "value", "pid"), ranges).select("key", "value").sortWithinPartitions("key", "value")
    ordered.write.format("fixedrecord").mode("overwrite" if overwrite else "append").option("cap", cap).option("bases", bases).option("path", out).save()
    return SortResult(n_records, n_files, ranges, dropped)
