"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Each figure is the median of three runs, of the 2 GB sort a single one. Sorts of 64, 128, 320 MB and 2 GB of records
"""

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = ["record_scan", "global_sort", "run_sort", "kway_merge", "split_points", "range_partition_assign", "range_partition_sizes", "range_join_partition", "rolling_output", "output_manifest", "validate_sorted", "duplicate_keys", "checksum", "length_sum"]
SIZES = {"file_sort_64mb": (640_000, 3), "file_sort_128mb": (1_280_000, 3), "file_sort_320mb": (3_200_000, 3), "file_sort_skewed_320mb": (3_200_000, 3), "file_sort_2gb": (20_000_000, 1)}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from keyloom.plans import queries
    from keyloom.plans.file_sort import sort_files
    from keyloom.sources import datagen
    from keyloom.sources.fixed_record import register

    queries.QUERIES["range_partition_sizes"](spark, sf_dir).count()  # warm-up
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.time()
            queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
            spark.catalog.clearCache()
        took[name] = round(statistics.median(runs), 3)
    register(spark)
    work = tempfile.mkdtemp(prefix="keyloom-bench-")
    try:
        for name, (n, times) in SIZES.items():
            source, runs = f"{work}/{name}-in", []
            made = datagen.skew if "skewed" in name else datagen.uniform
            made(spark, n, seed=1, partitions=int(cpus)).select("key", "value").write.format("fixedrecord").mode("append").option("path", source).save()
            for _ in range(times):
                began = time.time()
                done = sort_files(spark, [source], f"{work}/{name}-out")
                runs.append(time.time() - began)
                assert done.records == n
                shutil.rmtree(f"{work}/{name}-out")
            took[name] = round(statistics.median(runs), 3)
            shutil.rmtree(source)
    finally:
        shutil.rmtree(work, ignore_errors=True)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
