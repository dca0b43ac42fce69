"""Near-duplicate embeddings by an epsilon grid order join.

cosine >= c means that unit vectors lie within epsilon = sqrt(2 - 2c). Vectors are projected on
their leading principal directions; projections never lengthen distances, so boxes of projections
that are more than epsilon apart prove that no pair of theirs is near. The directions come from a
bounded sample and only affect speed.

Vectors are sorted by grid cells (of side epsilon) of their projections. Consecutive runs of that
order become blocks of a fixed size in bytes, with bounding boxes; consecutive blocks form a group
with a box of its own. Only boxes of groups, one for some 260,000 vectors, are known everywhere; blocks of
two groups that are not provably apart are compared box by box, in a join. Pairs of blocks that are
not provably apart are joined by a task each, recursively: both sequences are halved and their boxes
compared again, until short ones are compared by a matrix product in single precision. Only pairs
whose product lies closer to the threshold than its rounding can reach are computed again, in double precision.

A leaf of that recursion returns each vector's number of links and a spanning forest, so neither a leaf
nor a task holds all pairs of a dense group. Equal vectors are one row with their number until the end.

Defined results: vectors that are null, zero, or hold null or non-finite components link with
nothing, nor do rows without an id. Very large and very small vectors are scaled by a power of two first,
so that their lengths neither overflow nor vanish. Vectors of different lengths are compared only within their
length. Ids are taken to be distinct; vectors that share one share their links. Other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import cut, hot_keys, spread_join
from keyloom.llm.components import components, spanning

LEADING, LEAF, SAMPLE = 8, 512, 4096
#: Bytes of a block's vectors, and blocks in a group.
BLOCK_BYTES, GROUP = 2 << 20, 64


def slack(width: int) -> float:
    """More than a product of unit vectors can miss by in single precision, in any order of summing."""
    return (width + 8) * 2.0**-23


def principal(rows: DataFrame, k: int = LEADING) -> np.ndarray:
    """Leading directions of at most SAMPLE unit vectors, those with the smallest hashes."""
    found = rows.select("x", F.xxhash64("x").alias("h")).orderBy("h").limit(SAMPLE).collect()
    x = np.array([r["x"] for r in found])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    _, vectors = np.linalg.eigh(np.cov(x.T, bias=True) if len(x) > 1 else np.eye(x.shape[1]))
    return vectors[:, ::-1][:, : min(k, x.shape[1])]


def _box(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return p.min(axis=0), p.max(axis=0)


def apart(a: tuple, b: tuple, epsilon: float) -> bool:
    """Whether two boxes are further apart than epsilon."""
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(gap @ gap) > epsilon * epsilon


class Block:
    def __init__(self, ids: np.ndarray, count: np.ndarray, x: np.ndarray, directions: np.ndarray):
        self.ids, self.count, self.x = ids, count, x
        self.norm = np.linalg.norm(x, axis=1)
        unit = x / self.norm[:, None]
        self.unit, self.p = unit.astype(np.float32), unit @ directions
        self._boxes: dict[tuple[int, int], tuple] = {}

    def box(self, lo: int, hi: int) -> tuple:
        got = self._boxes.get((lo, hi))
        if got is None:
            got = self._boxes[(lo, hi)] = _box(self.p[lo:hi])
        return got


def leaf_links(a: Block, b: Block, i: int, j: int, k: int, m: int, cosine: float, step: int = 4096) -> np.ndarray:
    """Which rows i..j of a and k..m of b are near; of one block with itself each pair once."""
    product = a.unit[i:j] @ b.unit[k:m].T
    room = slack(a.x.shape[1])
    near = product >= cosine + room
    r, c = np.nonzero((product >= cosine - room) & ~near)  # too close to tell
    for at in range(0, len(r), step):
        u, v = r[at : at + step], c[at : at + step]
        near[u, v] = np.einsum("ij,ij->i", a.x[i + u], b.x[k + v]) / (a.norm[i + u] * b.norm[k + v]) >= cosine
    if a is b:
        near &= np.arange(i, j)[:, None] < np.arange(k, m)[None, :]
    return near


def join_blocks(a: Block, b: Block, cosine: float, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Links of each row of a, of each row of b, a spanning forest (u, v) and how many leaves were compared.

    Rows of b count on from those of a, or are the same if the blocks are.
    """
    n = len(a.ids)
    shift = 0 if a is b else n
    links_a, links_b = np.zeros(n, np.int64), np.zeros(len(b.ids), np.int64)
    us, vs, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    stack = [(0, n, 0, len(b.ids))]
    while stack:
        i, j, k, m = stack.pop()
        if apart(a.box(i, j), b.box(k, m), epsilon):
            continue
        if j - i <= LEAF and m - k <= LEAF:
            leaves += 1
            near = leaf_links(a, b, i, j, k, m, cosine)
            if near.any():
                links_a[i:j] += near @ b.count[k:m]
                links_b[k:m] += a.count[i:j] @ near
                r, c = np.nonzero(near)
                if a is b and i == k:
                    u, v = spanning(r, c, j - i)
                    us.append(u + i)
                    vs.append(v + i)
                else:
                    u, v = spanning(r, c + (j - i), j - i + m - k)
                    place = lambda x: np.where(x < j - i, x + i, x - (j - i) + k + shift)  # noqa: B023, E731
                    us.append(place(u))
                    vs.append(place(v))
            continue
        u, v = ((i + j) // 2 if j - i > LEAF else j), ((k + m) // 2 if m - k > LEAF else m)
        for lo, hi in ((i, u), (u, j)):
            for left, right in ((k, v), (v, m)):
                if lo < hi and left < right and not (a is b and right <= lo):  # below the diagonal
                    stack.append((lo, hi, left, right))
    u, v = spanning(np.concatenate(us), np.concatenate(vs), shift + len(b.ids))
    return links_a, links_b, u, v, leaves


def _pack(ids: list, counts: list, xs: list) -> tuple[bytes, bytes, bytes]:
    return np.array(ids, np.int64).tobytes(), np.array(counts, np.int64).tobytes(), np.array(xs, np.float64).tobytes()


def _join_length(rows: DataFrame, width: int, cosine: float, block: int) -> DataFrame:
    """(kind, u, v): links (u, number) as kind 0, spanning links (u, v) as kind 1."""
    spark, epsilon = rows.sparkSession, float(np.sqrt(2 - 2 * cosine)) + 1e-9
    total = rows.count()
    directions = spark.sparkContext.broadcast(principal(rows))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), dtype=np.float64).reshape(batch.num_rows, width)
            c = np.floor((x / np.linalg.norm(x, axis=1, keepdims=True)) @ directions.value / epsilon).astype(np.int64) + 128
            key = [bytes(np.clip(r, 0, 255).astype(np.uint8)) for r in c]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.binary())], names=["id", "n", "x", "cell"])

    schema = "id long, n long, x array<double>, cell binary"
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (2 * block) + 1))
    ordered = rows.mapInArrow(cells, schema).repartitionByRange(parts, "cell", "id").sortWithinPartitions("cell", "id")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        task, n = pyspark.TaskContext.get().partitionId(), 0
        held: list = [[], [], []]

        def emit() -> pa.RecordBatch:
            nonlocal n
            x = np.array(held[2])
            lo, hi = _box(x / np.linalg.norm(x, axis=1, keepdims=True) @ directions.value)
            out = pa.RecordBatch.from_arrays([pa.array([task << 24 | n], pa.int64()), pa.array([list(lo)], pa.list_(pa.float64())), pa.array([list(hi)], pa.list_(pa.float64())), *(pa.array([x], pa.binary()) for x in _pack(*held))], names=["block", "lo", "hi", "ids", "counts", "xs"])
            n += 1
            for h in held:
                h.clear()
            return out

        for batch in batches:
            for i, c, x in zip(*(batch.column(k).to_pylist() for k in range(3))):
                held[0].append(i)
                held[1].append(c)
                held[2].append(x)
                if len(held[0]) == block:
                    yield emit()
        if held[0]:
            yield emit()

    made = cut(ordered.mapInArrow(blocks, "block long, lo array<double>, hi array<double>, ids binary, counts binary, xs binary"))
    boxes = made.select("block", F.expr(f"block div {GROUP}").alias("grp"), "lo", "hi")
    k = len(directions.value[0])
    groups = boxes.groupBy("grp").agg(F.array(*(F.min(F.col("lo")[i]) for i in range(k))).alias("lo"), F.array(*(F.max(F.col("hi")[i]) for i in range(k))).alias("hi"))
    known = sorted((r["grp"], r["lo"], r["hi"]) for r in groups.collect())  # one for GROUP blocks
    shared = spark.sparkContext.broadcast((np.array([g for g, _, _ in known]), np.array([x for _, x, _ in known]), np.array([x for _, _, x in known])))

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups that are not provably apart from a group and don't come before it."""
        names, lo, hi = shared.value
        for batch in batches:
            for g in batch.column(0).to_pylist():
                i = int(np.searchsorted(names, g))
                gap = np.maximum(0, np.maximum(lo[i:] - hi[i], lo[i] - hi[i:]))
                near = names[i:][(gap * gap).sum(axis=1) <= epsilon * epsilon]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), g), pa.int64()), pa.array(near, pa.int64())], names=["ga", "gb"])

    beside = spark.createDataFrame([(g,) for g, _, _ in known], "grp long").repartition(max(1, len(known) // 64)).mapInArrow(partners, "ga long, gb long")
    left = boxes.toDF("ba", "ga", "la", "ha")
    right = boxes.toDF("bb", "gb", "lb", "hb")
    gap = "aggregate(zip_with(zip_with(la, hb, (x, y) -> x - y), zip_with(lb, ha, (x, y) -> x - y), (x, y) -> greatest(0D, x, y)), 0D, (s, g) -> s + g * g)"
    near = cut(beside.join(left, "ga").join(right, "gb").where((F.col("ba") <= F.col("bb")) & (F.expr(gap) <= epsilon * epsilon)).select("ba", "bb").withColumn("pair", F.monotonically_increasing_id()))
    sides = near.select("pair", F.col("ba").alias("block"), F.lit(0).alias("side")).union(near.where("ba <> bb").select("pair", "bb", F.lit(1)))
    pairs = sides.join(made.select("block", "ids", "counts", "xs"), "block").drop("block")

    def join(group: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for r in group.sort_values("side").itertuples():
            ids = np.frombuffer(r.ids, np.int64)
            sides.append(Block(ids, np.frombuffer(r.counts, np.int64), np.frombuffer(r.xs, np.float64).reshape(len(ids), width), directions.value))
        a, b = sides[0], sides[-1]
        links_a, links_b, u, v, _ = join_blocks(a, b, cosine, epsilon)
        ids, links = (a.ids, links_a + links_b) if a is b else (np.concatenate([a.ids, b.ids]), np.concatenate([links_a, links_b]))
        some = np.nonzero(links)[0]
        return pd.concat([pd.DataFrame({"kind": 0, "u": ids[some], "v": links[some]}), pd.DataFrame({"kind": 1, "u": ids[u], "v": ids[v]})]).astype("int64")

    return pairs.groupBy("pair").applyInPandas(join, "kind long, u long, v long")


def link(df: DataFrame, cosine: float = 0.95, block_bytes: int = BLOCK_BYTES, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``df``."""
    x = F.col(embedding).cast("array<double>")
    fine = F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("x", lambda v: v != 0)
    most = F.array_max(F.transform("x", F.abs))
    scale = F.when(most > 1e140, 2.0**-600).when(most < 1e-140, 2.0**600).otherwise(1.0)  # exact: powers of two
    rows = df.select(F.col(vec_id).cast("long").alias("id"), x.alias("x")).withColumn("ok", F.coalesce(fine, F.lit(False))).withColumn("f", F.when(F.col("ok"), scale))
    rows = rows.withColumn("x", F.when(F.col("ok"), F.transform("x", lambda v: v * F.col("f") + F.lit(0.0)))).withColumn("h", F.when(F.col("ok"), F.md5(F.to_json("x"))))
    rows = cut(rows.select("id", "x", "ok", "h"))
    # equal vectors: one row with their number; partial sums spread a hot vector
    distinct = cut(rows.where("ok").groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.any_value("x").alias("x")))
    found, total = None, 0
    for r in sorted(distinct.groupBy(F.size("x").alias("w")).agg(F.sum("n").alias("n")).collect()):
        total += r["n"]
        one = _join_length(distinct.where(F.size("x") == r["w"]).select("id", "n", "x"), r["w"], cosine, max(16, block_bytes // (8 * r["w"])))
        found = one if found is None else found.union(one)
    if found is None:
        found = df.sparkSession.createDataFrame([], "kind long, u long, v long")
    found = cut(found)
    links = found.where("kind = 0").groupBy(F.col("u").alias("id")).agg(F.sum("v").alias("links"))
    parts = components(found.where("kind = 1").select(F.col("u").alias("a"), F.col("v").alias("b")))
    groups = distinct.select("h", "id", "n").join(links, "id", "left").join(parts.select(F.col("node").alias("id"), "component"), "id", "left")
    groups = groups.select("h", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = spread_join(rows.where("ok").select("id", "h"), groups, "h", "id", hot_keys(distinct, "h", total)).select("id", "n_links", "component_id")
    out = linked.union(rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(vec_id), F.col("n_links").cast("long").alias("n_links"), "component_id").withColumn("kept", F.col(vec_id) == F.col("component_id"))
