import numpy as np

from keyloom.llm import near_vectors


def brute(vectors, c=0.95):
    ok = {i: np.array(v, float) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links, parent = {i: set() for i, _ in vectors}, {i: i for i, _ in vectors}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = list(ok)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = ok[i], ok[j]
            if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= c:
                links[i].add(j)
                links[j].add(i)
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: (len(links[i]), root(i)) for i, _ in vectors}


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [rng.normal(size=16) for _ in range(150)]
    rows += [centres[k % 12] + rng.normal(size=16) * 0.2 for k in range(240)]  # around the threshold
    rows += [rows[3]] * 40 + [rows[200] * 2] * 5
    vectors = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    vectors += [(1000, None), (1001, [0.0] * 16), (1002, [1.0] * 15 + [float("nan")]), (1003, [1.0] * 15 + [None]), (1004, [float("inf")] * 16), (1005, [1.0, 0.0]), (1006, [1.0, 0.1]), (1007, [-0.0] * 15 + [1.0]), (1008, [0.0] * 15 + [1.0]), (1009, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, x string").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.link(df, block_bytes=8 * 16 * 30).collect()}
    assert got == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors])


def roots(u, v, n):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in zip(u.tolist(), v.tolist()):
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    return [root(i) for i in range(n)]


def test_boxes_skip_only_what_is_apart():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(1300, 8)), rng.normal(size=8) + 0.2 * rng.normal(size=(900, 8))])
    x = x[np.argsort(x[:, 0])]
    n, count = len(x), rng.integers(1, 4, len(x))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    epsilon = np.sqrt(2 - 1.8)
    one = near_vectors.Block(np.arange(n), count, x, np.eye(8)[:, :4])
    links_a, links_b, u, v, leaves = near_vectors.join_blocks(one, one, 0.9, epsilon)
    assert (links_a + links_b == near @ count).all() and len(u) < n
    assert roots(u, v, n) == roots(*np.nonzero(near), n)
    a, b = (near_vectors.Block(np.arange(len(s)), count[s], x[s], np.eye(8)[:, :4]) for s in (np.arange(1000), np.arange(1000, n)))
    links_a, links_b, u, v, leaves = near_vectors.join_blocks(a, b, 0.9, epsilon)
    assert (links_a == near[:1000, 1000:] @ count[1000:]).all() and (links_b == count[:1000] @ near[:1000, 1000:]).all()
    cross = near.copy()
    cross[:1000, :1000] = cross[1000:, 1000:] = False
    assert roots(u, v, n) == roots(*np.nonzero(cross), n)


def test_a_dense_group_needs_little_memory():
    import tracemalloc

    rng = np.random.default_rng(7)
    x = rng.normal(size=768) + 0.1 * rng.normal(size=(1500, 768))
    a, b = (near_vectors.Block(np.arange(len(p)), np.ones(len(p), np.int64), p, np.eye(768)[:, :8]) for p in (x[:700], x[700:]))
    tracemalloc.start()
    links_a, links_b, u, v, _ = near_vectors.join_blocks(a, b, 0.95, np.sqrt(0.1) + 1e-9)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert (links_a == 800).all() and (links_b == 700).all() and len(u) == 1499


def test_vectors_at_the_threshold_and_of_extreme_lengths(spark):
    rows = [(0, [3.0, 4.0]), (1, [0.6e200, 0.8e200]), (2, [1.2e-300, 1.6e-300]), (3, [5e-324, 0.0]), (4, [1e308, 0.0])]
    a = np.arccos(0.95)
    rows += [(10, [1.0, 0.0, 0.0]), (11, [np.cos(a - 1e-9), np.sin(a - 1e-9), 0.0]), (12, [np.cos(a + 1e-9), -np.sin(a + 1e-9), 0.0])]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.link(df).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (1, 3), 10: (1, 10), 11: (1, 10), 12: (0, 12)}


def test_hot_vectors_and_many_blocks(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 8))
    rows = [(i, [float(x) for x in base[i % 40]]) for i in range(3000)] + [(5000 + i, [float(x) for x in rng.normal(size=8)]) for i in range(1500)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_bytes=8 * 8 * 40).collect()}
    x = np.array([v for _, v in rows])
    unit, ids = x / np.linalg.norm(x, axis=1, keepdims=True), np.array([i for i, _ in rows])
    near = np.einsum("id,jd->ij", unit, unit) >= 0.95
    np.fill_diagonal(near, False)
    labels = roots(*np.nonzero(near), len(ids))
    assert got == {int(i): (int(n), int(ids[labels[k]])) for k, (i, n) in enumerate(zip(ids, near.sum(axis=1)))}


def test_empty_table(spark):
    assert near_vectors.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
