"""The file catalog: (mid, path, size, replicas), its filters, updates and placements.

Paths carry a symbolic root: @{input}, @{working} or @{output}.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTITION_PATH = r"^@\{working\}/partition\.(\d+).(\d+)$"
SCHEMA = "mid int, path string, size bigint, replicas array<int>"


def file_catalog(df: DataFrame) -> DataFrame:
    """(path, size, rows) of the files a DataFrame reads, from file metadata."""
    return df.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("rows"))


def is_input(path: Column) -> Column:
    return path.startswith("@{input}")


def without_inputs(catalog: DataFrame) -> DataFrame:
    return catalog.where(~is_input(F.col("path")))


def parsed(catalog: DataFrame) -> DataFrame:
    """Range slices with their run and owner, both read off the path; other files are left out."""
    hit = catalog.where(F.col("path").rlike(PARTITION_PATH))
    return hit.withColumn("run", F.regexp_extract("path", PARTITION_PATH, 1).cast("long")).withColumn("owner", F.regexp_extract("path", PARTITION_PATH, 2).cast("long")).withColumn("suffix", F.substring_index("path", ".", -1))


def resolve(path: Column, input: str = "/", working: str = "/working", output: str = "/output") -> Column:
    """Symbolic roots replaced by folders; input paths are absolute already."""
    out = F.when(path.startswith("@{working}"), F.concat(F.lit(working.rstrip("/")), F.substring(path, 11, 1 << 20)))
    out = out.when(path.startswith("@{output}"), F.concat(F.lit(output.rstrip("/")), F.substring(path, 10, 1 << 20)))
    return out.when(path.startswith("@{input}"), F.concat(F.lit(input.rstrip("/")), F.substring(path, 9, 1 << 20))).otherwise(path)


def sync_diff(local: DataFrame, known: DataFrame) -> DataFrame:
    """Files a machine has that the catalog doesn't know: they may go."""
    return local.select("mid", "path").subtract(known.select("mid", "path"))


def update(catalog: DataFrame, deleted: DataFrame, added: DataFrame) -> DataFrame:
    """Rows by (mid, path): deleted ones go, added ones replace what has their name."""
    gone = deleted.select("mid", "path").union(added.select("mid", "path"))
    return catalog.join(gone, ["mid", "path"], "left_anti").select(catalog.columns).unionByName(added.select(catalog.columns))


def obsolete(catalog: DataFrame) -> DataFrame:
    """Working files held by the machine that made them: consumed once a stage is complete."""
    return catalog.where(F.col("path").startswith("@{working}") & (F.element_at("replicas", 1) == F.col("mid")))


def placements(catalog: DataFrame, machines: DataFrame) -> DataFrame:
    """(path, mid): every machine that holds a replica."""
    held = catalog.select("path", F.explode("replicas").alias("mid")).distinct()
    return held.join(F.broadcast(machines), "mid").select("path", "mid")


def merge_inputs(catalog: DataFrame, machines: DataFrame) -> DataFrame:
    """(mid, files, bytes): the slices that each machine merges; machines without any have none."""
    by = parsed(catalog).groupBy(F.col("owner").alias("mid")).agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))
    return machines.select(F.col("mid").cast("long").alias("mid")).join(by, "mid", "left").select("mid", F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def least_loaded(load: DataFrame, name: str = "mid", by: str = "pending") -> DataFrame:
    """The machine with the smallest load; ties go to the smallest id."""
    return load.agg(F.min_by(name, F.struct(by, name)).alias(name), F.min(by).alias(by))


def machine_order(machines: DataFrame, name: str = "mid") -> DataFrame:
    return machines.withColumn("pos", (F.row_number().over(Window.orderBy(name)) - 1).cast("long"))


def flags(catalog: DataFrame) -> DataFrame:
    """(any_input, all_sized): whether there is anything to do, and whether every file has a size."""
    return catalog.agg(F.coalesce(F.bool_or(is_input(F.col("path"))), F.lit(False)).alias("any_input"), F.coalesce(F.bool_and(F.col("size") >= 0), F.lit(True)).alias("all_sized"))


def nonempty_inputs(catalog: DataFrame) -> DataFrame:
    """Machines that have input files, with their number."""
    return catalog.where(is_input(F.col("path"))).groupBy("mid").agg(F.count("*").alias("files"))
