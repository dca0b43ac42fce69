"""Global and per-run sorts, positions, k-way merge."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("key", "value")


def global_sort(records: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Total order: a sampled range exchange, then a spilling sort in each range."""
    return records.orderBy(*order)


def with_positions(records: DataFrame, order: tuple[str, ...] = ORDER, name: str = "pos") -> DataFrame:
    """``records`` with their position in the total order, from 0.

    No task sees all rows: rows are range partitioned and sorted, each partition numbers its own, and
    the partitions' sizes (one row each) give the offsets. The sorted rows are persisted because both
    uses must see the same partition bounds; lost blocks are recomputed with the same bounds.
    """
    ordered = records.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    part = F.shiftright("_row", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_row").bitwiseAND((1 << 33) - 1)).drop("_part", "_row", "_before")


def positions_within(records: DataFrame, group: str, order: tuple[str, ...] = ORDER, name: str = "pos") -> DataFrame:
    """``records`` with their position in the order of their group, from 0; groups are few, and may be of any size.

    One total order by group, then the rest: a large group is spread over tasks. Each group's first
    position is subtracted; it is one row a group.
    """
    numbered = with_positions(records, (group, *order), "_pos")
    firsts = numbered.groupBy(group).agg(F.min("_pos").alias("_first"))
    return numbered.join(F.broadcast(firsts), group).withColumn(name, F.col("_pos") - F.col("_first")).drop("_pos", "_first")


def run_sort(records: DataFrame, run: str = "run", order: tuple[str, ...] = ORDER, name: str = "pos") -> DataFrame:
    """Each run sorted on its own, with positions from 0 in the run."""
    return positions_within(records, run, order, name)


def kway_merge(runs: list[DataFrame], order: tuple[str, ...] = ORDER) -> DataFrame:
    """Sorted runs to one sorted sequence; no runs give None, one run is returned sorted.

    Spark merges spilled runs inside its sort; the union is range partitioned once.
    """
    if not runs:
        raise ValueError("a merge needs the schema of at least one run")
    return global_sort(reduce(DataFrame.unionByName, runs), order)


def run_numbering(records: DataFrame, run: str = "run") -> DataFrame:
    """Distinct runs numbered from 0 in their order; there are few runs, rows are reduced first."""
    return records.select(run).distinct().withColumn("number", (F.row_number().over(Window.orderBy(run)) - 1).cast("long"))


def top_k(records: DataFrame, k: int, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The first ``k`` records: each task keeps k, no full sort."""
    return records.orderBy(*order).limit(k)


def sort_fanout(records: DataFrame, outputs: int, name: str = "output") -> DataFrame:
    """The same rows once for each output, made in the row's own task."""
    return records.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(outputs - 1).cast("long"))))
