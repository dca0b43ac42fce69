"""Connected components of links between rows, without bringing them together anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import FEW_ROWS, cut, hot_keys, spread_join


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable; only nodes that have links.

    Alternating stars: links of a node to larger neighbours move to its smallest neighbour, then
    links to smaller ones do. Every round halves paths; minima are partial aggregates, and in joins
    a hot node's links are dealt to many tasks, so a star of any size is spread.
    """
    x, y = F.col(a), F.col(b)
    now = cut(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hot = hot_keys(least, "u", 2 * seen[0], worth=FEW_ROWS)
        large = spread_join(both.where(F.col("v") > F.col("u")), least.select("u", F.least("u", "m").alias("m")), "u", "v", hot).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hot = hot_keys(least, "u", seen[0], worth=FEW_ROWS)
        small = spread_join(large, least.select("u", "m"), "u", "v", hot).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        then, seen = seen, mark(now)
        if then == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same local components 0..n-1 as (a, b), at most one a node."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        nxt = label.copy()
        np.minimum.at(nxt, label[a], low)
        np.minimum.at(nxt, label[b], low)
        nxt = nxt[nxt]
        while (nxt[nxt] != nxt).any():
            nxt = nxt[nxt]
        nxt = nxt[label]
        if (nxt == label).all():
            break
        label = nxt
    i = np.nonzero(label != np.arange(n))[0]
    return i, label[i]
