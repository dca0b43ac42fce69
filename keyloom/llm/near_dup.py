"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is its five-word shingles, weighted 1 + log2(occurrences). Every shingle is a Poisson
process of arrivals whose rate is its weight; an arrival falls on a random register, and a register
keeps the shingle of its first arrival. A shingle stops when its next arrival is later than the
document's latest register. Registers agree with the probability Jaccard similarity of documents.
A text that repeats shingles has a second set of registers in which every weight is 1; they agree
with plain Jaccard. For other texts the two are the same. Bands and screens go by both.

Documents with equal registers in a band meet in a bucket. Groups of copies may be any size, so
buckets never make all pairs:

1. Documents with equal weighted shingles are one class from the start.
2. In each bucket every class meets the one with the smallest id only. Of a class's candidates the one
   with the most equal registers, of either set, is verified on the texts; verified links give components.
3. In buckets that still hold several components, what lies outside the largest is compared with
   the rest, other components only: no link between classes is lost to the choice of leaders, and a
   bucket that is one group of copies is done. Buckets beyond ``SMALL`` rows do so in blocks:
   a task holds the shingle sets of two blocks, compares all of them exactly and returns a forest of links.

In smaller buckets a screen comes first: it rules out a pair whose equal registers lie four standard deviations below
the threshold in both sets. A pair at the very threshold is lost to it about as rarely as to the bands
(1e-4), one above it far more rarely. Verification is exact: probability Jaccard or plain Jaccard of the shingles of at least
``threshold``.

Rows are told apart by their id and a hash of their text, so rows that share an id are documents of
their own, each in the class of its own text. class_id is the smallest id in the class. Of a class
one document is kept: the one with that id and, if several texts share it, the smallest hash; rows
that repeat both id and text are one document and are all marked.

Joins on what may be hot (a bucket, a leader, a text with many copies) deal such rows to many tasks.

Defined results: null texts, and rows without an id, are alone. Texts without words are one class
if they are equal. A text shorter than a shingle is one shingle. Texts of any length are hashed whole.
Other columns are not read, whatever their names. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import FEW_ROWS, cut, hot_keys, spread_join, tidy
from keyloom.llm.components import components, spanning
from keyloom.llm.tokens import WideHasher, mix, ngrams

SHINGLE, REGISTERS, ROWS = 5, 120, 5
BANDS = REGISTERS // ROWS
#: Standard deviations below the threshold at which a pair is not verified.
SCREEN = 4
#: Buckets of more than SMALL rows are compared in blocks of BLOCK rows.
SMALL, BLOCK = 32, 128
#: Up to so many ids, 8 bytes each, are sent to the texts; beyond, texts and ids are dealt out by id.
SENT_IDS = 1_000_000


def shingles(words: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and their weights."""
    found, count = np.unique(ngrams(words, n), return_counts=True)
    return found, 1 + np.log2(count)


def weighted_set(s: bytes, n: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and weights from what ``_sets_of`` packs."""
    found = np.frombuffer(s, np.uint64)
    return found, np.ones(len(found)) if n is None else 1 + np.log2(np.frombuffer(n, np.uint32))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of probability Jaccard and plain Jaccard of two weighted shingle sets.

    J_P = sum over shared d of 1 / sum over all e of max(a_e / a_d, b_e / b_d).
    """
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    plain = len(i) / (len(a[0]) + len(b[0]) - len(i))
    wa, wb = a[1][i], b[1][j]
    rest_a, rest_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    if np.abs(wa - wb).max() < 1e-9:
        return max(plain, float(wa.sum() / (rest_a + rest_b + wa.sum())))
    # pairs of weights take few values, because occurrences do
    weights, count = np.unique(np.stack([wa, wb], axis=1), axis=0, return_counts=True)
    x, y = weights[:, 0], weights[:, 1]
    inner = np.maximum(x[None, :] / x[:, None], y[None, :] / y[:, None]) @ count
    return max(plain, float((count / (rest_a / x + rest_b / y + inner)).sum()))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers (documents x m, 32 bits of the winning shingle)."""
    n = len(sets)
    element = np.concatenate([s for s, _ in sets]) if sets else np.zeros(0, np.uint64)
    weight = np.concatenate([w for _, w in sets]) if sets else np.zeros(0)
    doc = np.repeat(np.arange(n), [len(s) for s, _ in sets])
    time, owner = np.full(n * m, np.inf), np.zeros(n * m, dtype=np.uint32)
    name = (element >> np.uint64(32)).astype(np.uint32)
    at = np.zeros(len(element))
    turn = 0
    while len(element):
        turn += 1
        r = mix(element + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = at - np.log1p(-((r >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / weight
        slot = doc * m + (mix(r) % np.uint64(m)).astype(np.int64)
        better = np.nonzero(at < time[slot])[0]
        better = better[np.argsort(-at[better], kind="stable")]  # of several on one register the earliest is written last
        time[slot[better]], owner[slot[better]] = at[better], name[better]
        latest = time.reshape(n, m).max(axis=1)
        on = at < latest[doc]  # later arrivals of the others cannot win any register
        element, weight, doc, name, at = element[on], weight[on], doc[on], name[on], at[on]
    return owner.reshape(n, m)


def plain_signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> list[np.ndarray | None]:
    """Registers with all weights 1; None where that is what the weights are, so the others serve."""
    out: list[np.ndarray | None] = [None] * len(sets)
    at = [i for i, (_, w) in enumerate(sets) if len(w) and w.max() > 1]
    for i, r in zip(at, signatures([(sets[i][0], np.ones(len(sets[i][0]))) for i in at], m)):
        out[i] = r
    return out


def least_equal(threshold: float, m: int = REGISTERS) -> int:
    """Equal registers of ``m`` that a pair at ``threshold`` has but for SCREEN standard deviations."""
    return int(m * (threshold - SCREEN * np.sqrt(threshold * (1 - threshold) / m)))


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; it includes the band's number."""
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), BANDS)).copy()
    part = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    for k in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + part[:, :, k])
    return out.view(np.int64)


def _sketch(df: DataFrame) -> DataFrame:
    """(id, th, fp, registers, plain, bands) of each text (id, th, t) with words or without; fp stands for the weighted set.

    ``plain`` is null where it equals ``registers``. Bands of both share their keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hasher = WideHasher(limit=100_000)
        for batch in batches:
            for start in range(0, batch.num_rows, 400):
                part = batch.slice(start, 400)
                texts = part.column(2).to_pylist()
                sets = [shingles(hasher.ids(t)) for t in texts]
                fp = [xxhash.xxh128_hexdigest(s.tobytes() + w.tobytes()) if len(s) else "=" + xxhash.xxh128_hexdigest(t.encode("utf-8", "surrogatepass")) for (s, w), t in zip(sets, texts)]
                full = np.array([len(s) > 0 for s, _ in sets])
                registers = signatures(sets)
                plain = plain_signatures(sets)
                keys = [k if p is None else np.unique(np.concatenate([k, band_keys(p[None, :])[0]])) for k, p in zip(band_keys(registers), plain)]
                plain = pa.array([None if p is None else p.view(np.int32) for p in plain], pa.list_(pa.int32()))
                lists = lambda x, kind: pa.array([r if f else None for r, f in zip(x, full)], pa.list_(kind))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp, pa.string()), lists(registers.view(np.int32), pa.int32()), plain, lists(keys, pa.int64())], names=["id", "th", "fp", "registers", "plain", "bands"])
        tidy()

    return df.mapInArrow(run, "id long, th long, fp string, registers array<int>, plain array<int>, bands array<long>")


def _equal_registers() -> str:
    """Equal registers of ra, pa and rb, pb: the more of the two sets'."""
    equal = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> IF(x = y, 1, 0)), 0, (s, e) -> s + e)"
    return f"CASE WHEN pa IS NULL AND pb IS NULL THEN {equal('ra', 'rb')} ELSE greatest({equal('ra', 'rb')}, {equal('coalesce(pa, ra)', 'coalesce(pb, rb)')}) END"


def _texts_of(texts: DataFrame, members: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, t) of the distinct nodes ``asked`` for, repeated rows as often as they are; few spare the texts a shuffle.

    ``members`` has (node, id, th).
    """
    asked = cut(asked)
    sent = F.broadcast if asked.limit(SENT_IDS + 1).count() <= SENT_IDS else lambda x: x
    need = members.select("node", "id", "th").join(sent(asked), "node")
    return texts.join(sent(need), ["id", "th"]).select("node", "t")


def _sets_of(texts: DataFrame, members: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, s, n) of each node ``asked`` for: distinct shingles, and how often they occur if any repeats, packed; repetitive texts become short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WideHasher(limit=100_000)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                got = [np.unique(ngrams(hasher.ids(t), SHINGLE), return_counts=True) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s, _ in got], pa.binary()), pa.array([n.astype(np.uint32).tobytes() if n.max(initial=1) > 1 else None for _, n in got], pa.binary())], names=["node", "s", "n"])
        tidy()

    # repeated rows have equal sets: one of them, before the shuffle
    return _texts_of(texts, members, asked).mapInArrow(run, "node long, s binary, n binary").groupBy("node").agg(F.first("s").alias("s"), F.first("n").alias("n"))


def _hot_b(pairs: DataFrame) -> list[tuple]:
    """Nodes that very many of the checkpointed ``pairs`` have as b."""
    return hot_keys(pairs.groupBy("b").agg(F.count("*").alias("n")), "b", pairs.count(), worth=FEW_ROWS)


def verify(texts: DataFrame, members: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes whose texts (id, th, t) are similar enough, with their similarity.

    ``members`` has (node, id, th). Only texts that are asked for are moved, as shingle sets.
    """
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    held = cut(_sets_of(texts, members, asked))
    left = pairs.join(held.toDF("a", "sa", "na"), "a")
    both = spread_join(left, held.toDF("b", "sb", "nb"), "b", "a", _hot_b(pairs)).select("a", "b", "sa", "na", "sb", "nb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                sets = zip(*(part.column(i).to_pylist() for i in range(2, 6)))
                s = [similarity(weighted_set(sa, na), weighted_set(sb, nb)) for sa, na, sb, nb in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64())], names=["a", "b", "similarity"])
        tidy()

    return both.mapInArrow(run, "a long, b long, similarity double").where(F.col("similarity") >= threshold)


def _scored(pairs: DataFrame, sides: DataFrame, threshold: float) -> DataFrame:
    """Pairs with the number of equal registers, where it passes the screen. Many pairs may share b."""
    left = pairs.join(sides.withColumnsRenamed({"node": "a", "registers": "ra", "plain": "pa"}), "a")
    both = spread_join(left, sides.withColumnsRenamed({"node": "b", "registers": "rb", "plain": "pb"}), "b", "a", _hot_b(pairs))
    return both.select("a", "b", F.expr(_equal_registers()).alias("same")).where(F.col("same") >= least_equal(threshold))


def _mixed(buckets: DataFrame, parts: DataFrame, hot: list[tuple]) -> DataFrame:
    """(key, node, c, most, n, nx) of buckets that hold several components.

    ``most`` is the largest component there, n the bucket's size and nx what lies outside of it.
    """
    placed = buckets.select("key", "node").join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    sizes = placed.groupBy("key", "c").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("c", F.struct("n", -F.col("c"))).alias("most"), F.count("*").alias("parts"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("nx")).where("parts > 1").drop("parts")
    return spread_join(placed, mixed, "key", "node", hot)


def _small(placed: DataFrame, sides: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) across components in buckets of at most SMALL rows that pass the screen."""
    placed = placed.join(sides, "node")
    x = placed.where("c <> most").select("key", F.col("node").alias("a"), F.col("c").alias("ca"), F.col("registers").alias("ra"), F.col("plain").alias("pa"))
    y = placed.select("key", F.col("node").alias("b"), F.col("c").alias("cb"), (F.col("c") != F.col("most")).alias("outside"), F.col("registers").alias("rb"), F.col("plain").alias("pb"))
    cross = x.join(y, (x["key"] == y["key"]) & (x["ca"] != y["cb"]) & (~y["outside"] | (x["a"] < y["b"])) & (F.expr(_equal_registers()) >= least_equal(threshold)))
    return cross.select("a", "b")


def block_links(p: list[tuple[np.ndarray, np.ndarray]], q: list[tuple[np.ndarray, np.ndarray]], threshold: float, columns: int = 4096) -> np.ndarray:
    """Which weighted shingle sets of ``p`` and ``q`` have a similarity of at least ``threshold``; exact.

    Shared shingles are counted by products of indicator matrices, ``columns`` shingles at a time. Where shingles
    repeat, probability Jaccard is at most the share that either set's shared shingles have of its weight; what that
    does not rule out is computed.
    """
    sizes = [np.array([len(s) for s, _ in x], dtype=np.float64) for x in (p, q)]
    sums = [np.array([w.sum() for _, w in x]) for x in (p, q)]
    heavy = [np.array([len(w) > 0 and w.max() > 1 for _, w in x]) for x in (p, q)]
    flat = [np.concatenate([s for s, _ in x] or [np.zeros(0, np.uint64)]) for x in (p, q)]
    weight = [np.concatenate([w for _, w in x] or [np.zeros(0)]).astype(np.float32) for x in (p, q)]
    row = [np.repeat(np.arange(len(x)), n.astype(np.int64)) for x, n in zip((p, q), sizes)]
    words = np.intersect1d(flat[0], flat[1])
    shared = np.zeros((len(p), len(q)))
    of_p, of_q = np.zeros_like(shared), np.zeros_like(shared)
    at = [np.searchsorted(words, f) for f in flat]
    on = [np.nonzero((i < len(words)) & (words[np.minimum(i, len(words) - 1)] == f))[0] if len(words) else np.zeros(0, np.int64) for i, f in zip(at, flat)]
    on = [o[np.argsort(i[o], kind="stable")] for o, i in zip(on, at)]
    place = [i[o] for i, o in zip(at, on)]
    weighted = heavy[0].any() or heavy[1].any()
    for lo in range(0, len(words), columns):
        is_in, weighs = [], []
        for k, n in enumerate((len(p), len(q))):
            a, b = np.searchsorted(place[k], (lo, lo + columns))
            own, col = on[k][a:b], place[k][a:b] - lo
            m = np.zeros((n, columns), np.float32)
            m[row[k][own], col] = 1
            is_in.append(m)
            if weighted:
                w = np.zeros((n, columns), np.float32)
                w[row[k][own], col] = weight[k][own]
                weighs.append(w)
        shared += is_in[0] @ is_in[1].T
        if weighted:
            of_p += weighs[0] @ is_in[1].T
            of_q += is_in[0] @ weighs[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - shared
    near = (shared > 0) & (shared >= threshold * union - 1e-9)
    near &= np.divide(shared, union, out=np.zeros_like(shared), where=union > 0) >= threshold
    if weighted:
        room = threshold * (1 - 1e-5)  # products are in single precision
        maybe = (heavy[0][:, None] | heavy[1][None, :]) & ~near & (of_p >= room * sums[0][:, None]) & (of_q >= room * sums[1][None, :]) & (shared > 0)
        for i, j in zip(*np.nonzero(maybe)):
            near[i, j] = similarity(p[i], q[j]) >= threshold
    return near


def _large(placed: DataFrame, texts: DataFrame, members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) across components in larger buckets, verified in blocks.

    What lies outside the largest component meets the bucket block by block; a task holds the shingle sets of
    two blocks and returns a spanning forest of their links, so its output is linear in its input.
    """
    sets = cut(_sets_of(texts, members, placed.select("node").distinct())).toDF("node", "words", "counts")
    rows = placed.join(sets, "node").withColumns({"nxb": F.ceil(F.col("nx") / block), "nyb": F.ceil(F.col("n") / block), "h": F.xxhash64("node")})
    base = ["key", "node", "c", (F.col("c") != F.col("most")).alias("outside"), "words", "counts"]
    x = rows.where("c <> most").select(*base, F.lit(0).alias("side"), F.expr("pmod(h, nxb)").alias("xb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nyb") - 1)).alias("yb"))
    y = rows.select(*base, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nxb") - 1)).alias("xb"), F.expr("pmod(h, nyb)").alias("yb"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        p, q = group[group.side == 0], group[group.side == 1]
        if not len(p) or not len(q):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        cp, cq, ip, iq, out = p.c.to_numpy(), q.c.to_numpy(), p.node.to_numpy(), q.node.to_numpy(), q.outside.to_numpy()
        near = block_links(*([weighted_set(s, n) for s, n in zip(z.words, z.counts)] for z in (p, q)), threshold)
        near &= (cp[:, None] != cq[None, :]) & (~out[None, :] | (ip[:, None] < iq[None, :]))
        i, j = np.nonzero(near)
        nodes, local = np.unique(np.concatenate([ip[i], iq[j]]), return_inverse=True)
        u, v = spanning(local[: len(i)], local[len(i) :], len(nodes))
        return pd.DataFrame({"a": nodes[u], "b": nodes[v]})

    return x.union(y).groupBy("key", "xb", "yb").applyInPandas(compare, "a long, b long")


def classes(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, kept, text_hash): class_id is the smallest id of the class, whose document is kept.

    ``text_hash`` is xxhash64 of the text: with the id it names the document.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).withColumn("th", F.xxhash64("t"))
    texts = rows.where(F.col("id").isNotNull() & F.col("t").isNotNull()).select("id", "th", "t")
    sketch = cut(_sketch(texts))
    members = sketch.groupBy("fp").agg(F.min(F.struct("id", "th")).alias("first"), F.count("*").alias("n"), *(F.any_value(c).alias(c) for c in ("registers", "plain", "bands")))
    # nodes are numbered once: the checkpoint holds the numbers
    members = cut(members.select(F.monotonically_increasing_id().alias("node"), "fp", "first.id", "first.th", "n", "registers", "plain", "bands"))
    total = members.count()
    buckets = members.where("bands IS NOT NULL").select("node", "id", F.explode("bands").alias("key"))
    # copies are more often like the first of their group than like one another
    shared = cut(buckets.groupBy("key").agg(F.min_by("node", F.struct("id", "node")).alias("leader"), F.count("*").alias("n")).where("n > 1"))
    hot = hot_keys(shared, "key", 2 * BANDS * total)
    buckets = cut(spread_join(buckets, shared.select("key", "leader"), "key", "node", hot))  # only buckets of two and more
    sides = members.where("registers IS NOT NULL").select("node", "registers", "plain")
    pairs = cut(buckets.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())
    best = cut(_scored(pairs, sides, threshold).groupBy("a").agg(F.max_by("b", F.struct("same", -F.col("b"))).alias("b")))
    found = cut(verify(texts, members, best, threshold).select("a", "b"))
    ordered = lambda pairs: pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    placed = cut(_mixed(buckets, components(found), hot))
    cross = _small(placed.where(F.col("n") <= SMALL), sides, threshold)
    cross = cut(ordered(cross).distinct().join(ordered(best), ["a", "b"], "left_anti"))
    second = cut(verify(texts, members, cross, threshold).select("a", "b").union(_large(placed.where(F.col("n") > SMALL), texts, members, threshold)))
    parts = components(found.union(second))
    named = members.select("fp", "id", "th", "node").join(parts, "node", "left").select("fp", "id", "th", F.coalesce("component", "node").alias("c"))
    firsts = named.groupBy("c").agg(F.min(F.struct("id", "th")).alias("first"), F.count("*").alias("n"))
    named = spread_join(named, firsts.select("c", "first"), "c", "fp", hot_keys(firsts, "c", total, worth=FEW_ROWS)).select("fp", "first")
    rows_n = members.agg(F.sum("n")).first()[0] or 0
    out = spread_join(sketch.select("id", "th", "fp"), named, "fp", "id", hot_keys(members, "fp", rows_n))
    out = out.select("id", F.col("first.id").alias("class_id"), ((F.col("id") == F.col("first.id")) & (F.col("th") == F.col("first.th"))).alias("kept"), F.col("th").alias("text_hash"))
    rest = rows.where(F.col("id").isNull() | F.col("t").isNull()).select("id", F.col("id").alias("class_id"), F.lit(True).alias("kept"), F.when(F.col("t").isNotNull(), F.col("th")).alias("text_hash"))
    return out.union(rest).withColumnRenamed("id", doc_id)
