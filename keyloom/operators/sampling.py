"""Samples for split points: heads of runs, or a spread sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEAD_RECORDS = 10_000


def head(records: DataFrame, k: int = HEAD_RECORDS, run: str = "run", natural: tuple[str, ...] = ("key", "value")) -> DataFrame:
    """The first ``k`` records of every run in its natural order; tasks keep k rows a run before the shuffle."""
    w = Window.partitionBy(run).orderBy(*natural)
    return records.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).withColumn("pos", (F.col("pos") - 1).cast("long"))


def first_run(records: DataFrame, machine: str = "machine", run: str = "run") -> DataFrame:
    """Each machine's first run: the one that it samples."""
    return records.groupBy(machine).agg(F.min(run).alias(run))


def spread(records: DataFrame, size: int = 100_000, columns: tuple[str, ...] = ("key",), seed: int = 17, total: int | None = None) -> DataFrame:
    """About ``size`` rows of ``columns`` from everywhere, chosen by hash: the same whatever the partitioning.

    A sorted first file would bias a head sample; ranges from a spread one are balanced. All columns of
    ``records`` enter the hash, so rows of one frequent key are chosen one by one. ``total`` spares the count.
    """
    n = records.count() if total is None else total
    share = min(1.0, size / max(1, n))
    top = int(-(2**63) + share * (2**64 - 1))
    return records.where(F.xxhash64(F.lit(seed), *records.columns) <= F.lit(min(top, 2**63 - 1))).select(*columns)


def concatenated(sample: DataFrame, run: str = "run", key: str = "key") -> DataFrame:
    """Each run's sample keys as one text, in order; samples are bounded."""
    return sample.groupBy(run).agg(F.array_join(F.array_sort(F.collect_list(F.hex(key))), "").alias("keys"), F.count("*").alias("n"))
