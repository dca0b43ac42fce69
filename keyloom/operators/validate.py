"""Checks of sorted output: order, order across ranges, counts, multiset, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order_violations(ordered: DataFrame, key: str = "key") -> DataFrame:
    """One row: how many records have a smaller key than the record before; equal keys are in order.

    ``ordered`` is in the order of its partitions, as a sort or range exchange leaves it. Neighbours are compared
    within each partition, in Arrow batches; of a partition only its ends leave the task.
    """
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext

        first = last = None
        bad = n = 0
        for b in batches:
            keys = b.column(0).to_pylist()
            if not keys:
                continue
            bad += sum(x > y for x, y in zip(keys, keys[1:])) + (last is not None and last > keys[0])
            first, last, n = keys[0] if first is None else first, keys[-1], n + len(keys)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary()), pa.array([bad], pa.int64())], names=["part", "first", "last", "bad"])

    ends = ordered.select(F.col(key).cast("binary").alias("k")).mapInArrow(run, "part int, first binary, last binary, bad long")
    before = F.lag("last").over(Window.orderBy("part"))  # one row a partition
    return ends.withColumn("before", before).agg(F.coalesce(F.sum(F.col("bad") + F.when(F.col("before") > F.col("first"), 1).otherwise(0)), F.lit(0)).cast("long").alias("violations"))


def range_violations(assigned: DataFrame, key: str = "key", name: str = "pid") -> DataFrame:
    """One row: neighbouring non-empty ranges whose keys overlap."""
    ends = assigned.groupBy(name).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    before = F.lag("hi").over(Window.orderBy(name))  # one row a range
    return ends.withColumn("before", before).agg(F.count_if(F.col("before") > F.col("lo")).cast("long").alias("violations"))


def count_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n_in, n_out, equal)."""
    n_in, n_out = a.agg(F.count("*").alias("n_in")), b.agg(F.count("*").alias("n_out"))
    return n_in.crossJoin(n_out).withColumn("equal", F.col("n_in") == F.col("n_out"))


def checksum(records: DataFrame) -> DataFrame:
    """(n, checksum): a sum over records of 32 bits of their MD5, whatever their order."""
    word = F.conv(F.substring(F.md5(F.concat(F.hex("key"), F.hex("value"))), 1, 8), 16, 10).cast("long")
    return records.agg(F.count("*").alias("n"), F.sum(word).cast("long").alias("checksum"))


def duplicate_keys(records: DataFrame, key: str = "key") -> DataFrame:
    """(n, distinct_keys, duplicates): counts by key first, so one hot key is one partial row a task."""
    by = records.groupBy(key).agg(F.count("*").alias("c"))
    return by.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n"), F.count("*").alias("distinct_keys")).withColumn("duplicates", F.col("n") - F.col("distinct_keys"))
