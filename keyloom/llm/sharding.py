"""Sharding by minimax contiguous partition.

Groups of equal texts are atomic. They are put in order of a hash of their text, and the order is
cut into at most ``shards`` runs so that the largest run is as small as any cut can make it: a
binary search over capacities, each checked greedily (fill a shard until the next group would not
fit), and cuts where the greedy check with the smallest feasible capacity cuts.

Groups are as many as documents, so neither they nor their order reach the driver. The driver holds
sizes of hash ranges, ``2**LEVEL_BITS`` at a time. Ranges bound the greedy check from both sides; only
ranges in which the two bounds still differ are split further, until the smallest capacity is exact.
The key has 60 bits, so there are at most four rounds, each one pass over (key, size).

Numbers within a shard come from a range shuffle on (key, doc_id) and offsets of its partitions.
A hot group is spread over partitions there, because doc_id is part of the range key.

A group larger than an equal share sets the capacity, as no cut can do better. The other shards then may
fill up to it while the last ones stay empty; ``apart`` gives such groups, fewer than ``shards``, the last shards for themselves
and cuts the order of the others, which is no longer one partition of the whole order.

Defined results: null texts count one byte and form a group with empty ones. The law is `bytes`:
sizes are as near to equal as whole groups allow. Texts of any length count whole. Equal doc_ids keep separate
slots; ties of key and id are numbered in any order. Rows without an id come first in their group. Only id and text are read, whatever other
columns are named. Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import cut

KEY_BITS, LEVEL_BITS = 60, 15


def group_key(text: Column) -> Column:
    """The first 60 bits of the text's MD5: the order of groups."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def greedy(sizes: np.ndarray, capacity: int) -> list[int] | None:
    """Ends of runs when each takes all that fits; None if a group alone is larger."""
    total = np.cumsum(sizes)
    ends, done = [], 0
    while done < len(sizes):
        base = total[done - 1] if done else 0
        nxt = int(np.searchsorted(total, base + capacity, side="right"))
        if nxt == done:
            return None
        ends.append(nxt)
        done = nxt
    return ends


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """Binary search for the smallest capacity with which ``shards`` runs hold all groups."""
    if not len(sizes):
        return 0
    lo, hi = int(max(sizes.max(), -(-int(sizes.sum()) // shards))), int(sizes.sum())
    while lo < hi:
        mid = (lo + hi) // 2
        ends = greedy(sizes, mid)
        if ends is not None and len(ends) <= shards:
            hi = mid
        else:
            lo = mid + 1
    return lo


class Ranges:
    """Sizes of consecutive key ranges: ``atom`` ones are single groups, the others hold several."""

    def __init__(self, lo: np.ndarray, bits: np.ndarray, size: np.ndarray, groups: np.ndarray, largest: np.ndarray):
        order = np.argsort(lo, kind="stable")
        self.lo, self.bits, self.size, self.groups, self.largest = (x[order] for x in (lo, bits, size, groups, largest))
        self.before = np.concatenate([[0], np.cumsum(self.size)])
        self.atom = self.groups == 1

    def last_fit(self, limit: int) -> tuple[int, int, int]:
        """How far a run may reach whose end must lie at or below ``limit`` (in cumulative size).

        (surely reached, at most reached, range in which it is open or -1).
        """
        i = int(np.searchsorted(self.before, limit, side="right")) - 1
        if i >= len(self.size) or self.before[i] == limit or self.atom[i]:
            return int(self.before[i]), int(self.before[i]), -1
        return int(self.before[i]), min(limit, int(self.before[i + 1]) - 1), i

    def check(self, capacity: int, shards: int) -> tuple[bool | None, list[int]]:
        """Whether ``capacity`` suffices, or None with the ranges to split to know it.

        Greedy runs that start earlier never end later, so the two bounds stay bounds throughout.
        """
        low = high = 0
        opened: list[int] = []
        total = int(self.before[-1])
        for _ in range(shards):
            a, _, i = self.last_fit(low + capacity)
            _, b, j = self.last_fit(high + capacity)
            opened += [x for x in (i, j) if x >= 0]
            low, high = a, b
        if low >= total:
            return True, []
        if high < total:
            return False, []
        return None, sorted(set(opened))


def alone(groups: DataFrame, shards: int) -> list[int]:
    """Keys of groups above an equal share of what is left when larger ones have shards of their own."""
    left = groups.agg(F.sum("size")).first()[0] or 0
    found = []
    for r in groups.orderBy(F.desc("size"), "key").limit(shards - 1).collect():
        if r["size"] * (shards - len(found)) <= left or len(found) == shards - 1:
            break
        found.append(r["key"])
        left -= r["size"]
    return found


def plan(groups: DataFrame, shards: int, key: str = "key") -> tuple[int, list[int]]:
    """The smallest capacity, and where shards 1, 2, ... start: above the last key of the shard before.

    ``groups`` has a row (key, size) for each group.
    """

    def ranges_at(bits: int, inside: list[tuple[int, int]] | None) -> list:
        """Sizes by the leading bits, of all keys or of those in some ranges (first key, bits)."""
        rows = groups
        if inside is not None:
            hit = F.lit(False)
            for lo, b in inside:
                hit = hit | F.col(key).between(lo, lo + (1 << (KEY_BITS - b)) - 1)
            rows = rows.where(hit)
        part = F.shiftright(key, KEY_BITS - bits)
        return rows.groupBy(part.alias("p")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("size").alias("most")).collect()

    def made(rows: list, bits: int) -> tuple[np.ndarray, ...]:
        a = np.array([(r["p"] << (KEY_BITS - bits), bits, r["size"], r["n"], r["most"]) for r in rows], dtype=np.int64).reshape(-1, 5)
        return tuple(a[:, i] for i in range(5))

    ranges = Ranges(*made(ranges_at(LEVEL_BITS, None), LEVEL_BITS))
    if not len(ranges.size):
        return 0, []
    lo = max(int(ranges.largest.max()), -(-int(ranges.before[-1]) // shards))
    hi = int(ranges.before[-1])

    def split(opened: list[int]) -> "Ranges":
        out = [tuple(np.delete(getattr(ranges, n), opened) for n in ("lo", "bits", "size", "groups", "largest"))]
        by_bits: dict[int, list[tuple[int, int]]] = {}
        for i in opened:
            by_bits.setdefault(int(ranges.bits[i]), []).append((int(ranges.lo[i]), int(ranges.bits[i])))
        for bits, inside in by_bits.items():
            # finer by what keeps the answer within 2**LEVEL_BITS rows
            finer = min(KEY_BITS, bits + max(1, LEVEL_BITS - (len(inside) - 1).bit_length()))
            out.append(made(ranges_at(finer, inside), finer))
        return Ranges(*(np.concatenate([x[k] for x in out]) for k in range(5)))

    while lo < hi:
        # narrow the search as far as the known ranges decide; remember what was open
        mid = (lo + hi) // 2
        ok, opened = ranges.check(mid, shards)
        if ok is None:
            # both bounds shrink first, so that one round splits only ranges that matter
            a, b = lo, hi
            while b - a > 1:
                m = (a + b) // 2
                if ranges.check(m, shards)[0] is True:
                    b = m
                else:
                    a = m
            top = b  # surely feasible
            a, b = lo - 1, top
            while b - a > 1:
                m = (a + b) // 2
                if ranges.check(m, shards)[0] is False:
                    a = m
                else:
                    b = m
            lo, hi = max(lo, a + 1), min(hi, top)
            if lo >= hi:
                break
            opened = sorted({i for c in (lo, (lo + hi) // 2, hi - 1) for i in ranges.check(c, shards)[1]})
            if opened:
                ranges = split(opened)
        elif ok:
            hi = mid
        else:
            lo = mid + 1
    # the cuts of the greedy check at the smallest capacity, made exact in the same way
    while True:
        at, ends, opened = 0, [], []
        while at < ranges.before[-1] and not opened:
            a, _, i = ranges.last_fit(at + lo)
            if i >= 0:
                opened.append(i)
            ends.append(a)
            at = a
        if not opened:
            break
        ranges = split(opened)
    starts = [int(ranges.lo[int(np.searchsorted(ranges.before, e, side="left"))]) for e in ends if e < ranges.before[-1]]
    return lo, starts


def shard(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", apart: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, key, shard, slot) of every document."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("crc"), group_key(t).alias("key"))
    rows = cut(rows)
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("size")))
    large = alone(groups, shards) if apart else []
    _, starts = plan(groups.where(~F.col("key").isin(large)) if large else groups, shards - len(large))
    number = F.lit(0)
    for s in starts:
        number = number + (F.col("key") >= F.lit(s)).cast("int")
    for i, k in enumerate(large):
        number = F.when(F.col("key") == F.lit(k), shards - 1 - i).otherwise(number)
    ordered = rows.withColumn("shard", number)
    # a range shuffle, then one number for each row of a partition: no row meets all others
    ordered = cut(ordered.repartitionByRange("shard", "key", "id").sortWithinPartitions("shard", "key", "id").withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", 33)
    counts = ordered.groupBy(part.alias("p"), "shard").agg(F.count("*").alias("n"), F.min("row").alias("first")).collect()  # partitions + shards rows
    offsets, seen = [], {}
    for r in sorted(counts, key=lambda r: (r["shard"], r["p"])):
        offsets.append((r["p"], r["shard"], seen.get(r["shard"], 0) - r["first"]))
        seen[r["shard"]] = seen.get(r["shard"], 0) + r["n"]
    shift = spark.createDataFrame(offsets, "p long, shard int, shift long")
    out = ordered.withColumn("p", part).join(F.broadcast(shift), ["p", "shard"])
    return out.select(F.col("id").alias(doc_id), "size", F.col("crc").alias("text_crc32"), "key", "shard", (F.col("row") + F.col("shift")).alias("slot"))
