"""Planning of output files: size caps, contiguous numbers, the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.records import RECORD_LEN
from keyloom.operators.sorting import positions_within

MEGABYTE = 1_000_000
DEFAULT_CAP = 128 * MEGABYTE


def records_per_file(cap: int) -> int:
    """A cap in bytes must hold whole records."""
    if cap <= 0 or cap % RECORD_LEN:
        raise ValueError(f"the output file size must be a positive multiple of {RECORD_LEN} bytes, not {cap}")
    return cap // RECORD_LEN


def files_by_range(sizes: DataFrame, per_file: int) -> DataFrame:
    """(pid, n, files, base): every range has ceil(n / per_file) files, numbered on from the ranges before."""
    files = sizes.withColumn("files", F.expr(f"(n + {per_file - 1}) div {per_file}"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    return files.withColumn("base", F.coalesce(F.sum("files").over(before), F.lit(0)).cast("long"))


def manifest(sizes: DataFrame, per_file: int) -> DataFrame:
    """(file_no, pid, n, lo, hi): all output files before they are written; all but a range's last are full."""
    planned = files_by_range(sizes, per_file).where("files > 0")
    each = planned.select("pid", "n", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("files") - 1)).alias("k"))
    return each.select((F.col("base") + F.col("k")).alias("file_no"), "pid", F.least(F.lit(per_file).cast("long"), F.col("n") - F.col("k") * per_file).alias("n"), (F.col("k") * per_file).alias("lo"), F.least((F.col("k") + 1) * per_file, F.col("n")).alias("hi"))


def rolling(assigned: DataFrame, per_file: int, order: tuple[str, ...] = ("key", "value"), name: str = "pid") -> DataFrame:
    """Records with the number of the output in their range, every ``per_file`` records a new one."""
    return positions_within(assigned, name, order).withColumn("chunk", F.expr(f"pos div {per_file}"))
