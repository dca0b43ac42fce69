"""Deterministic record generators: uniform, ASCII and skewed keys, as DataFrames without Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _value(seed: str) -> F.Column:
    """A space, 87 bytes of chained MD5 text, CR LF."""
    text = F.concat(*(F.md5(F.concat(F.lit(f"{seed}-{i}-"), F.col("id").cast("string"))) for i in range(3)))
    return F.concat(F.encode(F.concat(F.lit(" "), F.substring(text, 1, 87)), "utf-8"), F.lit(bytearray(b"\r\n")))


def uniform(spark: SparkSession, n: int, seed: int = 0, offset: int = 0, partitions: int | None = None) -> DataFrame:
    """Keys are the first ten bytes of an MD5 of seed and number; ``offset`` continues a series."""
    ids = spark.range(offset, offset + n, 1, partitions)
    key = F.unhex(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string"))), 1, 20))
    return ids.select("id", key.alias("key"), _value(str(seed)).alias("value"))


def ascii(spark: SparkSession, n: int, seed: int = 0, offset: int = 0, partitions: int | None = None) -> DataFrame:
    """Keys of printable characters."""
    ids = spark.range(offset, offset + n, 1, partitions)
    key = F.encode(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string"))), 1, 10), "utf-8")
    return ids.select("id", key.alias("key"), _value(str(seed)).alias("value"))


def skew(spark: SparkSession, n: int, seed: int = 0, hot: int = 100, partitions: int | None = None) -> DataFrame:
    """39 of 40 records take one of ``hot`` keys."""
    own = F.concat(F.lit(f"{seed}-"), F.when(F.col("id") % 40 == 0, F.col("id")).otherwise(F.col("id") % hot).cast("string"))
    return spark.range(0, n, 1, partitions).select("id", F.unhex(F.substring(F.md5(own), 1, 20)).alias("key"), _value(str(seed)).alias("value"))
