import random

import numpy as np
import pytest

from keyloom.llm import near_dup
from keyloom.llm.tokens import WideHasher


def brute(texts):
    """Classes by exact similarity of all pairs."""
    h = WideHasher()
    sets = {i: near_dup.shingles(h.ids(t)) for i, t in texts.items() if t is not None}
    plain = {i: set(s[0].tolist()) for i, s in sets.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = plain[i], plain[j]
            if texts[i] == texts[j] or (a and b and min(len(a), len(b)) >= 0.5 * max(len(a), len(b)) and a & b and near_dup.similarity(sets[i], sets[j]) >= 0.8):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: root(i) for i in texts}


def test_similarity_is_jaccard_for_equal_weights_and_matches_its_definition():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 30, 20)).astype(np.uint64)
        b = np.unique(rng.integers(0, 30, 20)).astype(np.uint64)
        one = lambda x: (x, np.ones(len(x)))
        assert near_dup.similarity(one(a), one(b)) == pytest.approx(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        w, v = rng.integers(1, 4, len(a)).astype(float), rng.integers(1, 4, len(b)).astype(float)
        p, q = dict(zip(a.tolist(), w)), dict(zip(b.tolist(), v))
        jp = sum(1 / sum(max(p.get(e, 0) / p[d], q.get(e, 0) / q[d]) for e in p.keys() | q.keys()) for d in p.keys() & q.keys())
        plain = len(p.keys() & q.keys()) / len(p.keys() | q.keys())
        assert near_dup.similarity((a, w), (b, v)) == pytest.approx(max(jp, plain))


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    got, want = [], []
    for k in range(60):
        a, b = np.unique(base[:250]), np.unique(np.concatenate([base[k : 250 - k], rng.integers(0, 2**63, k).astype(np.uint64)]))
        sets = [(a, 1 + (a % np.uint64(3)).astype(float)), (b, 1 + (b % np.uint64(3)).astype(float))]
        s = near_dup.signatures(sets)
        got.append((s[0] == s[1]).mean())
        want.append(near_dup.similarity(*sets))
    assert abs(np.mean(got) - np.mean(want)) < 0.02 and np.corrcoef(got, want)[0, 1] > 0.95


def test_classes_equal_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(120)]
    for k in range(150):  # a dense group whose members differ among each other
        t = list(base)
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice(words)
        texts[10_000 + k] = " ".join(t)
    shared = [r.choice(words) for _ in range(90)]
    for k in range(60):  # a shared passage that makes half of each text: near nothing
        texts[20_000 + k] = " ".join(shared + [r.choice(words) for _ in range(60 + k)])
    for k, t in enumerate([None, None, "", "", "!!", "!!", "one two", "One, two.", "a b c d e", "x " * 3000]):
        texts[30_000 + k] = t
    rows = [(i, t, "x") for i, t in texts.items()] + [(None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = {x.doc_id: x for x in near_dup.classes(df).collect()}
    want = brute(texts)
    assert got.pop(None).kept
    assert {i: x.class_id for i, x in got.items()} == want
    assert all(x.kept == (i == want[i]) for i, x in got.items())


def test_empty_table(spark):
    assert near_dup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def repeated(r, words, n, part, times):
    """A text, and the same with its last ``part`` words said ``times`` times: plain Jaccard over 0.9, probability Jaccard under 0.8."""
    a = [r.choice(words) for _ in range(n)]
    b = a + a[-part:] * (times - 1)
    h = WideHasher()
    x, y = (near_dup.shingles(h.ids(" ".join(t))) for t in (a, b))
    assert len(np.intersect1d(x[0], y[0])) / len(np.union1d(x[0], y[0])) > 0.9
    assert (near_dup.signatures([x], 1024) == near_dup.signatures([y], 1024)).mean() < 0.79
    return " ".join(a), " ".join(b)


def test_pairs_that_only_plain_jaccard_links_are_found(spark):
    r = random.Random(11)
    words = [f"p{i}" for i in range(5000)]
    pairs = [repeated(r, words, *((150, 75, 4) if k % 2 else (300, 50, 50))) for k in range(40)]
    rows = [(2 * k + j, p[j]) for k, p in enumerate(pairs) for j in range(2)]
    got = {x.doc_id: x.class_id for x in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_a_text_and_itself_with_its_half_repeated(spark):
    r = random.Random(13)
    a = [r.choice([f"p{i}" for i in range(5000)]) for _ in range(104)]
    rows = [(1, " ".join(a)), (2, " ".join(a + a[:52] * 64))]
    h = WideHasher()
    assert near_dup.similarity(*(near_dup.shingles(h.ids(t)) for _, t in rows)) > 0.9
    assert [x.class_id for x in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [1, 1]


@pytest.mark.parametrize("block", [None, 16, 1000])  # a join, and buckets on each side of the block's size
def test_buckets_of_every_size_give_the_same_pairs(spark, block):
    r = random.Random(12)
    words = [f"p{i}" for i in range(5000)]
    pairs = [repeated(r, words, 150, 75, 4) for _ in range(80)]
    every = [p[j] for p in pairs for j in range(2)]
    placed = spark.createDataFrame([(1, i, i, 0, len(every), len(every) - 1) for i in range(len(every))], "key long, node long, c long, most long, n long, nx long")
    if block:
        texts = spark.createDataFrame([(i, i, t) for i, t in enumerate(every)], "id long, th long, t string")
        found = near_dup._large(placed, texts, texts.selectExpr("id AS node", "id", "th"), 0.8, block)
    else:
        h = WideHasher()
        sets = [near_dup.shingles(h.ids(t)) for t in every]
        signed, plain = near_dup.signatures(sets).view(np.int32), near_dup.plain_signatures(sets)
        sides = spark.createDataFrame([(i, s.tolist(), None if p is None else p.view(np.int32).tolist()) for i, (s, p) in enumerate(zip(signed, plain))], "node long, registers array<int>, plain array<int>")
        found = near_dup._small(placed, sides, 0.8)
    assert {tuple(sorted(x)) for x in found.collect()} == {(2 * k, 2 * k + 1) for k in range(80)}  # as a forest, too


def test_links_of_blocks_equal_those_of_pairs():
    rng = np.random.default_rng(17)
    base = np.unique(rng.integers(0, 2**63, 260)).astype(np.uint64)
    sets = []
    for k in range(60):
        s = np.unique(np.concatenate([rng.choice(base, 250 - 2 * (k % 40), replace=False), rng.integers(0, 2**63, k % 23).astype(np.uint64)]))
        sets.append((s, 1 + np.log2(rng.integers(1, 9, len(s)) if k % 3 else np.ones(len(s)))))
    sets += [(np.zeros(0, np.uint64), np.zeros(0)), (base[:1], np.ones(1)), (base[:5], np.full(5, 3.0))]
    p, q = sets[:30], sets[30:] + sets[:3]
    want = np.array([[near_dup.similarity(a, b) >= 0.8 for b in q] for a in p])
    assert 0 < want.mean() < 1
    for columns in (4096, 50):
        assert (near_dup.block_links(p, q, 0.8, columns) == want).all()


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen"
    rows = [(1, a), (7, a), (7, b), (9, b), (9, b), (4, a + "!"), (4, a)]
    got = sorted((x.doc_id, x.class_id, x.kept) for x in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == [(1, 1, True), (4, 1, False), (4, 1, False), (7, 1, False), (7, 7, True), (9, 7, False), (9, 7, False)]
    rows = [(4, a + "!"), (4, a), (4, a)]  # one class, one id, two texts: one of them is kept
    kept = [x.text_hash for x in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.kept]
    assert len(set(kept)) == 1


def test_hot_keys_are_dealt_out_and_lose_nothing(spark):
    from keyloom.llm.common import hot_keys, spread_join

    rows = spark.range(5000).selectExpr("IF(id % 3 = 0, id, 7) AS k", "id AS v")
    unique = spark.range(0, 5000).selectExpr("id AS k", "id * 2 AS w").where("k % 2 = 1")
    hot = hot_keys(rows.groupBy("k").count().withColumnRenamed("count", "n"), "k", 5000, least=100)
    assert [k for k, _ in hot] == [7]
    got = spread_join(rows, unique, "k", "v", hot)
    want = rows.join(unique, "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_recall_over_edited_copies(spark):
    """Copies of texts with words exchanged, all at 0.8 or more: at least nine of ten pairs share a class."""
    r = random.Random(21)
    words = [f"v{i}" for i in range(20_000)]
    h, rows, wanted = WideHasher(), [], []
    for k in range(300):
        a = [r.choice(words) for _ in range(r.randint(40, 400))]
        b = list(a)
        for _ in range(r.randint(1, max(1, len(a) // 45))):
            b[r.randrange(len(b))] = r.choice(words)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        if near_dup.similarity(*(near_dup.shingles(h.ids(t)) for _, t in rows[-2:])) >= 0.8:
            wanted.append(2 * k)
    got = {x.doc_id: x.class_id for x in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(wanted) > 200 and np.mean([got[i + 1] == i for i in wanted]) > 0.99
    assert all(got[2 * k + 1] in (2 * k, 2 * k + 1) and (2 * k in wanted or got[2 * k + 1] == 2 * k + 1) for k in range(300))
