import hashlib
import zlib

import numpy as np

from keyloom.llm import sharding


def key(t):
    return int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)


def brute(groups, shards):
    """Smallest capacity over the ordered groups, by trying every sum of consecutive ones."""
    sizes = [groups[k] for k in sorted(groups)]
    best = None
    for cap in sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)}):
        n, run = 1, 0
        for s in sizes:
            if s > cap:
                n = shards + 1
                break
            if run + s > cap:
                n, run = n + 1, 0
            run += s
        if n <= shards:
            best = cap
            break
    return best


def test_capacity_is_the_smallest(spark):
    rng = np.random.default_rng(0)
    for trial in range(3):
        sizes = rng.integers(1, 1000, 60)
        assert sharding.smallest_capacity(sizes, 7) == brute(dict(enumerate(sizes.tolist())), 7)
    keys = rng.integers(0, 1 << 60, 300).tolist() + [5 << 40 | i for i in range(40)]  # a crowd in one narrow range
    sizes = rng.integers(1, 5000, len(keys)).tolist()
    groups = dict(zip(keys, sizes))
    old = sharding.LEVEL_BITS
    sharding.LEVEL_BITS = 4  # few ranges, so that they are split again and again
    try:
        df = spark.createDataFrame(list(groups.items()), "key long, size long")
        for shards in (1, 3, 8):
            got, starts = sharding.plan(df, shards)
            order = sorted(groups)
            want = sharding.smallest_capacity(np.array([groups[k] for k in order]), shards)
            ends = sharding.greedy(np.array([groups[k] for k in order]), want)
            assert got == want
            assert [sum(k < s for k in order) for s in starts] == ends[:-1]
    finally:
        sharding.LEVEL_BITS = old


def test_shards_hold_whole_groups_and_slots_have_no_gaps(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(5000 + i, "hot text " * 30) for i in range(900)] + [(7000, None), (7001, ""), (7002, None)] + [(1, "again")] * 2
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string").repartition(6)
    got = sharding.shard(df, 8, apart=True).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    text = dict(rows)
    where = {}
    for r in got:
        if r.doc_id != 1:
            t = text[r.doc_id] or ""
            assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
            assert where.setdefault(t, r.shard) == r.shard
    sizes = {s: sum(r.size for r in own) for s, own in by.items()}
    hot = where["hot text " * 30]
    rest = [v for s, v in sizes.items() if s != hot]
    assert len(rest) == 7 and max(rest) < 2 * min(rest) + 40_000


def test_shards_are_runs_of_the_ordered_groups(spark, sf):
    """One minimax cut of all groups, whatever their sizes: the same as plain search and greedy filling."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for hot in (0, 700):
        every = rows + [(5000 + i, "hot text " * 30) for i in range(hot)]
        got = sharding.shard(spark.createDataFrame(every, "doc_id long, text string").repartition(5), 8).collect()
        groups, where = {}, {}
        for r in got:
            groups[r.key] = groups.get(r.key, 0) + r.size
            assert where.setdefault(r.key, r.shard) == r.shard
        order = sorted(groups)
        sizes = np.array([groups[k] for k in order])
        ends = sharding.greedy(sizes, sharding.smallest_capacity(sizes, 8))
        want = {order[i]: s for s, (lo, hi) in enumerate(zip([0, *ends], ends)) for i in range(lo, hi)}
        assert where == want


def test_small_and_empty_tables(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.shard for r in sharding.shard(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()] in ([0], [7])
