"""The record model: a 10-byte key and a 90-byte value, ordered by unsigned bytes.

Spark compares BINARY by unsigned bytes, a prefix before what it begins, so the key order is the
native one, and the exclusive upper end of the last range is 11 bytes of ff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY_LEN, VALUE_LEN = 10, 90
RECORD_LEN = KEY_LEN + VALUE_LEN
MIN_KEY = b"\x00" * KEY_LEN
MAX_KEY = b"\xff" * (KEY_LEN + 1)

RECORD_SCHEMA = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), False)])


def key_of(record: Column) -> Column:
    """Bytes 0 to 9 of a packed record."""
    return F.substring(record, 1, KEY_LEN)


def value_of(record: Column) -> Column:
    """Bytes 10 to 99 of a packed record."""
    return F.substring(record, KEY_LEN + 1, VALUE_LEN)


def packed(key: Column, value: Column) -> Column:
    return F.concat(key, value)


def key_literal(key: bytes) -> Column:
    return F.lit(bytearray(key))


def in_range(key: Column, lo: bytes, hi: bytes) -> Column:
    """Left-inclusive, right-exclusive membership."""
    return (key >= key_literal(lo)) & (key < key_literal(hi))


def hex_of(binary: Column) -> Column:
    """Upper-case hex keeps byte order, so text engines sort it alike."""
    return F.hex(binary)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by unsigned byte order."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def record_view(lineitem: DataFrame) -> DataFrame:
    """Line items as records: (key, value, run), the same in any engine that has MD5.

    The key is ten bytes of the MD5 of order and line number (not unique); the value stands for the
    rest of the row; ``run`` deals rows to four inputs.
    """
    key = F.md5(F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")))
    rest = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    rest += [F.round(F.col(c) * 100).cast("long").cast("string") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    return lineitem.select(
        F.unhex(F.substring(key, 1, 2 * KEY_LEN)).alias("key"),
        F.unhex(F.md5(F.concat_ws("|", *rest))).alias("value"),
        (F.col("l_suppkey") % 4).alias("run"),
    )
