"""Split points, ranges, range assignment and the exchange by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions.records import MAX_KEY, MIN_KEY, key_literal


def split_points(sample: DataFrame, parts: int, key: str = "key") -> DataFrame:
    """(i, end): the keys at (i * n) div parts for i = 1 .. parts - 1, then MAX_KEY.

    Exact by position; the sample is bounded. No sample or one part gives MAX_KEY alone.
    """
    ranked = sample.select(F.col(key).alias("key"), (F.row_number().over(Window.orderBy(key)) - 1).cast("long").alias("pos"))
    n = sample.agg(F.count("*").alias("n"))
    wanted = sample.sparkSession.range(1, max(parts, 1)).crossJoin(F.broadcast(n)).select(F.col("id").alias("i"), F.expr(f"id * n div {max(parts, 1)}").alias("pos"))
    inner = ranked.join(F.broadcast(wanted), "pos").select("i", F.col("key").alias("end"))
    last = n.select(F.when(F.col("n") == 0, 1).otherwise(max(parts, 1)).cast("long").alias("i"), key_literal(MAX_KEY).alias("end"))
    return inner.unionByName(last)


def collected_ends(points: DataFrame) -> list[bytes]:
    return [bytes(r["end"]) for r in sorted(points.collect(), key=lambda r: r["i"])]


def ranges(points: DataFrame) -> DataFrame:
    """(pid, lo, hi) with lo inclusive: each range starts at the end of the one before."""
    w = Window.orderBy("i")
    return points.select((F.row_number().over(w) - 1).cast("long").alias("pid"), F.lag("end", 1, bytearray(MIN_KEY)).over(w).alias("lo"), F.col("end").alias("hi"))


def ranges_frame(spark: SparkSession, ends: list[bytes]) -> DataFrame:
    rows = [(i, bytearray(ends[i - 1] if i else MIN_KEY), bytearray(e)) for i, e in enumerate(ends)]
    return spark.createDataFrame(rows, "pid long, lo binary, hi binary")


def assign(key: Column, ends: list[bytes]) -> Column:
    """The range of a key: how many ends are at or below it, capped to the last range.

    A balanced tree of comparisons in generated code; of equal ends the later range gets the rows.
    """

    def tree(lo: int, hi: int) -> Column:  # the answer lies in lo .. hi
        if lo == hi:
            return F.lit(lo).cast("long")
        mid = (lo + hi) // 2
        return F.when(key < key_literal(ends[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(ends) - 1)


def assign_many(records: DataFrame, ends: list[bytes], key: str = "key", name: str = "pid") -> DataFrame:
    """The same for more ends than an expression should hold, from a broadcast array in Arrow batches."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    shared = records.sparkSession.sparkContext.broadcast(ends)
    names = records.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema), f"`{name}` bigint"])
    at = names.index(key)

    def run(batches):
        # zero bytes at the end of a fixed-width value do not count, and need not: keys are equally long, ends their prefixes or longer
        found = np.array(shared.value)
        for b in batches:
            keys = np.array(b.column(at).to_pylist(), dtype=f"S{max(1, pa.compute.max(pa.compute.binary_length(b.column(at))).as_py() or 1)}")
            pid = np.minimum(np.searchsorted(found, keys, side="right"), len(found) - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pid, pa.int64())], names=[*names, name])

    return records.mapInArrow(run, schema)


def range_join(records: DataFrame, ends: list[bytes], bounds: DataFrame, key: str = "key") -> DataFrame:
    """``records`` with the row of ``bounds`` (pid, lo, hi) that holds their key.

    lo <= key < hi is decided by the tree of ``assign``, so the join is on pid, not on a comparison of all pairs.
    """
    return records.withColumn("pid", assign(F.col(key), ends)).join(bounds, "pid")


def sizes(assigned: DataFrame, parts: int, name: str = "pid") -> DataFrame:
    """(pid, n) of all ranges, empty ones with 0."""
    counts = assigned.groupBy(name).agg(F.count("*").alias("n"))
    every = assigned.sparkSession.range(parts).select(F.col("id").alias(name))
    return every.join(counts, name, "left").select(name, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def exchange(assigned: DataFrame, parts: int, name: str = "pid") -> DataFrame:
    """One task for each range, empty ones included; ids are exact, not hashed."""
    return assigned.repartitionById(parts, F.col(name).cast("int"))
