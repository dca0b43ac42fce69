"""What the operators of this package share: tables, checkpoints, samples, Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """Large tables of a Python worker: the last ones stay for its next task, others are let go.

    Those go back to the system before the next are made, and so does what making them took: else a worker
    that turns from one operator to another holds both.
    """
    if key not in _HELD:
        _HELD.clear()
        tidy()
        _HELD[key] = make()
        tidy()
    return _HELD[key]


def tidy() -> None:
    """Give memory that a task no longer uses back to the system: workers outlive tasks."""
    import contextlib
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that ``spark.checkpoint.dir`` names.

    Only a session within one process may do without: a folder of this machine is of no use to executors elsewhere.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="keyloom-checkpoint-")
        sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df``: its lineage ends in files every executor can read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def labelled_sample(rows: DataFrame, label: Column, per_label: int, doc_id: str = "doc_id", text: str = "text", least_chars: int = 0) -> list[tuple[object, str]]:
    """At most ``per_label`` (label, text) rows for each label value, chosen by a hash of the text.

    Only for fitting a classifier: labels x per_label whole texts reach the driver, whatever the
    table's size. Equal texts count once. The choice does not depend on partitioning. Null labels,
    null texts and texts shorter than ``least_chars`` are left out.
    """
    base = rows.select(label.alias("_y"), F.col(text).alias("_t"), F.xxhash64(F.col(text)).alias("_h")).where(F.col("_y").isNotNull() & (F.length("_t") >= least_chars))
    counts = {r["_y"]: r["n"] for r in base.groupBy("_y").agg(F.approx_count_distinct("_h").alias("n")).collect()}
    if not counts:
        return []
    # a threshold on the hash keeps about 4 x per_label rows of a label, without their texts; the smallest hashes win
    chosen: dict[object, list[int]] = {}
    keys = base.select("_y", "_h").where(thinned(F.col("_y"), F.col("_h"), counts, 4 * per_label)).distinct()
    for r in keys.withColumn("_n", F.row_number().over(Window.partitionBy("_y").orderBy("_h"))).where(F.col("_n") <= per_label).collect():
        chosen.setdefault(r["_y"], []).append(r["_h"])
    keep = F.lit(False)
    for value, hashes in chosen.items():
        keep = keep | ((F.col("_y") == F.lit(value)) & (F.col("_h") <= F.lit(max(hashes))))
    found = base.where(keep).groupBy("_y", "_h").agg(F.first("_t").alias("_t")).collect()
    return [(r["_y"], r["_t"]) for r in sorted(found, key=lambda r: (str(r["_y"]), r["_h"]))]


def thinned(label: Column, hashed: Column, counts: dict, about: int) -> Column:
    """True for about ``about`` rows of each label value, those with the smallest hashes."""
    keep = F.lit(False)
    for value, n in counts.items():
        share = min(1.0, about / max(1, n))
        top = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
        keep = keep | ((label == F.lit(value)) & (hashed <= F.lit(top)))
    return keep


#: Rows that one task can well read, whatever their keys.
FEW_ROWS = 100_000


def hot_keys(counts: DataFrame, key: str, total: int, least: int = 2_000, most_hot: int = 20_000, worth: int = 0) -> list[tuple]:
    """(key, parts) of keys that more rows share than one task should read; ``counts`` has (key, n).

    That is beyond ``least`` rows, or total / ``most_hot`` if that is more, so there are at most ``most_hot``. Up
    to ``worth`` rows in all are not worth a count that needs a shuffle: one task can read them.
    """
    if total <= max(least, worth):
        return []
    limit = max(least, total // most_hot)
    return [tuple(r) for r in counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit)).collect()]


def spread_join(rows: DataFrame, unique: DataFrame, key: str, by: str, hot: list[tuple]) -> DataFrame:
    """``rows`` joined with ``unique``, which has one row a key; rows of a ``hot`` key are dealt to its number of parts.

    Parts go by the hash of ``by``; ``unique`` repeats the row of a hot key once a part. Without hot keys it is a plain join.
    """
    if not hot:
        return rows.join(unique, key)
    parts = F.broadcast(rows.sparkSession.createDataFrame(hot, f"`{key}` {rows.schema[key].dataType.simpleString()}, _parts long"))
    left = rows.join(parts, key, "left").withColumn("_part", F.coalesce(F.expr(f"pmod(xxhash64(`{by}`), _parts)"), F.lit(0).cast("long"))).drop("_parts")
    right = unique.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1).cast("long")) - 1))).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")


def crc_mod(doc_id: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``: the folds of the fixed contracts."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(m)
