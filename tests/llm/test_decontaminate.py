import random

import numpy as np

from keyloom.llm import decontaminate as d
from keyloom.llm.tokens import WideHasher


def slow_align(a, b, match=1.0, mismatch=-0.5, gap=-0.5):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), h[i - 1, j] + gap, h[i, j - 1] + gap)
    return h.max()


def test_alignment_equals_the_plain_recurrence():
    r = np.random.default_rng(0)
    for _ in range(60):
        a, b = r.integers(0, 4, r.integers(1, 12)), r.integers(0, 4, r.integers(1, 30))
        score, start, end = d.align(a, b)
        assert abs(score - slow_align(a, b)) < 1e-9
        if score:
            assert abs(slow_align(a, b[start:end]) - score) < 1e-9


def test_finds_exact_and_edited_copies_and_leaves_clean_ones(spark, sf):
    r = random.Random(5)
    words = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(18, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, "two words"), (93, items_dup := "same item text here again and again ok")] + [(94, items_dup)]
    docs, want = [], set()
    for k in range(200):
        body = [r.choice(words) for _ in range(300)]
        if k % 2:
            i, text = items[r.randrange(40)]
            copy = text.split()
            if k % 4 == 3:  # one word in eight edited, one dropped, one put in
                copy = [r.choice(words) if r.random() < 0.125 else w for w in copy]
                del copy[len(copy) // 2]
                copy.insert(len(copy) // 3, "extra")
            body[100:100] = [w.upper() + "," for w in copy]
            want.add((k, i))
        docs.append((k, " ".join(body)))
    docs += [(500, None), (501, ""), (502, "x"), (503, "Two, words!"), (504, items_dup), (504, items_dup)]
    want |= {(503, 92), (504, 93), (504, 94)}
    a = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, similarity int").repartition(3)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, start int")
    found = d.find(a, b).collect()
    assert {(x.doc_id, x.item_id) for x in found} == want and len(found) == len(want) + 2
    in_blocks = d.find(a, b, block_words=300).collect()
    assert sorted(map(tuple, in_blocks)) == sorted(map(tuple, found))


def test_every_whole_item_in_the_documents_is_found(spark, sf):
    h = WideHasher()
    docs = {r.doc_id: h.ids(r.text).tobytes() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: h.ids(r.text).tobytes() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    whole = {(i, j) for i, t in docs.items() for j, w in items.items() if w and any(t[k : k + len(w)] == w for k in range(0, len(t) - len(w) + 1, 8))}
    from keyloom.llm import queries

    found = {(r.doc_id, r.item_id): r.similarity for r in queries.op3_decontamination(spark, sf).collect()}
    assert whole <= set(found) and all(found[x] == 1.0 for x in whole)


def test_empty_tables(spark):
    none_d, none_b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one_d, one_b = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert d.find(none_d, one_b).count() == d.find(one_d, none_b).count() == 0
    assert d.find(one_d, one_b).count() == 1


def edited(r, words, text, share):
    return [r.choice(words) if r.random() < share else w for w in text.split()]


def test_an_item_in_thousands_of_edited_copies_is_found_as_full_alignment_finds_it(spark):
    r, h = random.Random(6), WideHasher()
    words = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(r.choice(words) for _ in range(n))) for i, n in enumerate((9, 14, 27))]
    docs = []
    for k in range(2400):
        body = [r.choice(words) for _ in range(60)]
        body[30:30] = edited(r, words, items[k % 3][1], 0.25)
        docs.append((k, " ".join(body)))
    want, unseen = set(), set()
    for k, t in docs:
        for i, item in items:
            a, w = h.ids(item), h.ids(t)
            if np.isin(a, w).sum() >= 0.5 * len(a) and d.align(a, w)[0] >= 0.5 * len(a):
                want.add((k, i))
                if not np.isin(d.quick_ngrams(a, 3), d.quick_ngrams(w, 3)).any():
                    unseen.add((k, i))
    found = d.find(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in found} == want - unseen and len(want) > 2000 and len(unseen) < 0.05 * len(want)


def one_item(item, doc):
    h = WideHasher()
    b, w = d.block_of([(1, item)], 3, h), h.ids(doc)
    return d.matches(b, w, d.quick_ngrams(w, 3), 0.5), d.align(b.words[0], w)[0] / len(b.words[0])


def test_a_copy_with_a_long_block_put_inside_is_found_whole():
    r = random.Random(7)
    words = [f"v{i}" for i in range(3000)]
    for length, inside, edits in ((40, 25, 2), (40, 25, 3), (56, 33, 2), (56, 33, 3)):
        for _ in range(30):
            item = [r.choice(words) for _ in range(length)]
            copy = list(item)
            for k in r.sample(range(length), edits):
                copy[k] = r.choice(words)
            copy[length // 2 : length // 2] = [r.choice(words) for _ in range(inside)]
            doc = [r.choice(words) for _ in range(100)] + copy + [r.choice(words) for _ in range(100)]
            found, full = one_item(" ".join(item), " ".join(doc))
            assert (found[0][1] if found else 0.0) == (full if full >= 0.5 else 0.0)


def test_an_item_of_one_repeated_seed_is_found(spark):
    docs = spark.createDataFrame([(1, "she said no no no no no and left"), (2, "nothing at all in here")], "doc_id long, text string")
    found = d.find(docs, spark.createDataFrame([(1, "no no no no no")], "item_id long, text string")).collect()
    assert [(x.doc_id, x.similarity) for x in found] == [(1, 1.0)]


def test_recall_of_edited_copies_against_full_alignment():
    """Items copied with words replaced, dropped and put in; full Smith-Waterman over the whole document says which count."""
    r, h = random.Random(8), WideHasher()
    words = [f"v{i}" for i in range(4000)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([8, 15, 27, 40, 60])))) for i in range(60)]
    b = d.block_of(items, 3, h)
    caught = wanted = 0
    for k in range(400):
        i, text = items[r.randrange(60)]
        copy = [r.choice(words) if r.random() < (0.1, 0.2, 0.3)[k % 3] else w for w in text.split()]
        if k % 4 == 0:
            at = r.randrange(len(copy))
            copy[at:at] = [r.choice(words) for _ in range(len(copy) // 2)]
        body = [r.choice(words) for _ in range(120)]
        body[50:50] = copy
        doc = h.ids(" ".join(body))
        if d.align(b.words[i], doc)[0] / len(b.words[i]) >= 0.5:
            wanted += 1
            caught += i in [x[0] for x in d.matches(b, doc, d.quick_ngrams(doc, 3), 0.5)]
    assert wanted > 250 and caught / wanted > 0.97, (caught, wanted)


def test_blocks_hold_no_more_words_than_they_may(spark):
    items = spark.createDataFrame([(i, "a b " * n) for i, n in enumerate([3, 4, 500, 2, 2, 1])] + [(9, None)], "item_id long, text string")
    sizes = [[len((t or "").split()) for _, t in rows] for rows in d.blocks(items, "item_id", "text", 20)]
    assert sorted(x for s in sizes for x in s) == [0, 2, 4, 4, 6, 8, 1000] and all(len(s) == 1 or sum(s) <= 20 for s in sizes)
