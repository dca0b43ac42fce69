"""The pipeline against a plain version of every stage."""

import importlib.util
import random

import public_tokenizers
import pytest
import tiktoken

from keyloom.llm import bpe, decontaminate, pii
from keyloom.llm.tokens import WideHasher

spec = importlib.util.find_spec("corpus_pipeline")
pytestmark = pytest.mark.skipif(spec is None, reason="there is no pipeline")


def test_equals_brute_force(spark, sf, tmp_path):
    import corpus_pipeline
    from test_near_dup import brute as near
    from test_pii import brute as spans

    r = random.Random(8)
    docs = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select(corpus_pipeline.COLUMNS).collect()]
    items = {x.item_id: x.text for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    long = [d for d in docs if len(d[1]) > 800]
    for k in range(12):
        words = r.choice(long)[1].split()
        words[r.randrange(len(words))] = "changed"
        docs.append((50_000 + k, " ".join(words), "en", "near", 0))
        docs.append((51_000 + k, " ".join(r.choice(long)[1].split()[::-1]) + " " + items[k], "en", "leak", 0))
    docs += [(52_000, None, None, None, None), (52_001, "", "en", "s", 0), (52_002, "123 456 !!", "en", "s", 10), (52_003, "mail me@host.org or +1 (743) 555-3824 é", "en", None, 39)]
    docs += [(52_005, 'here token = "bc0d31ba76f17e56642e8751295a3fd50cd8e61f" stands', "en", "s", 1)]
    docs += [(52_004, "a repeated row that is long enough to be compared", "en", "s", 1)] * 2
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = {d[0]: d for d in docs if d[1] and any(c.isalpha() for c in d[1])}
    classes = near({i: d[1] for i, d in left.items()})
    left = {i: d for i, d in left.items() if classes[i] == i}
    h = WideHasher()
    item_words = [h.ids(t) for t in items.values()]

    def leaks(text):
        w = h.ids(text)
        return any(set(i.tolist()) & set(w.tolist()) and decontaminate.align(i, w)[0] / len(i) >= 0.5 for i in item_words)

    left = {i: d for i, d in left.items() if not leaks(d[1])}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    assert sorted(x.doc_id for x in got) == sorted(left)
    added = {x.doc_id: [(a.start, a.kind, a.end) for a in x.added] for x in pii.find(spark.createDataFrame([(i, d[1]) for i, d in left.items()], "doc_id long, text string")).collect()}
    assert any(added.values())
    for x in got:
        out, at = "", 0
        text = left[x.doc_id][1]
        found = sorted([s[:3] for s in spans(text)] + added[x.doc_id])
        for start, k, end in found:
            if start >= at:
                out += text[at:start] + f"<{pii.KINDS[k].upper()}>"
            at = max(at, end)
        out += text[at:]
        assert x.text == out and (x.lang, x.source) == left[x.doc_id][2:4]
        assert x.n_chars == (len(out) if found else left[x.doc_id][4])
        assert list(x.ids) == library.encode_ordinary(x.text) and x.decoded_text == x.text and x.n_tokens == len(x.ids)


def test_stages_keep_the_columns_and_survive_odd_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = [(None, "no id but some words", "en", "s", 5), (1, "one two three four five", None, None, None), (1, "another text of the same id", None, None, None)]
    odd = spark.createDataFrame([(*x, "k", 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, kept int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, str(tmp_path)).count() == (0 if name == "language_id" else 3), name  # no label of a row with an id, no language


def test_every_stage_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties and repeated rows, columns whose names clash."""
    import corpus_pipeline

    long = " ".join(f"w{i % 5000} goes" for i in range(40_000)) + " a@b.co"
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, long, "en", "s", len(long)), (4, "some words of a text", "en", "s", 20), (4, "some words of a text", "en", "s", 20), (4, "another text, the same id", "en", "s", 25), (None, "some words of a text", "en", "s", 20), (None, None, None, None, None), (6, "12 34 !!", "en", "s", 8), (7, "le chat et la maison de la rue", "fr", "s", 30)]
    spark.createDataFrame([(1, None), (2, ""), (None, "an item without an id")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(*x, "k", 1, 2, 3) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, id int, base int").repartition(3)
    key = lambda x: str(tuple(x))
    plain = sorted(map(str, rows))
    of = lambda name: sorted(map(key, dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path)).select(corpus_pipeline.COLUMNS).collect()))
    assert of("language_id") == sorted(str(x) for x in rows if x[1] and any(c.isalpha() for c in x[1]))
    assert of("near_dup") == sorted({str(x) for x in rows})
    assert of("decontamination") == plain
    assert of("pii") == sorted(str((*x[:1], x[1].replace("a@b.co", "<EMAIL>"), *x[2:4], len(long) + 1)) if x[0] == 3 else str(x) for x in rows)
    out = corpus_pipeline.byte_bpe(spark, docs, str(tmp_path)).collect()
    assert sorted(key(x)[: 10] for x in out) == sorted(str(x)[: 10] for x in rows) and all(x.decoded_text == (x.text or "") and x.n_tokens == len(x.ids) for x in out)


def test_a_contaminated_row_without_an_id_goes(spark, tmp_path):
    import corpus_pipeline

    item = "which of these seven words is the right answer here"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"before it {item} and after it"), (None, "nothing of the kind"), (None, None), (3, item), (4, "also nothing")]
    docs = spark.createDataFrame([(*x, "en", "s", 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(str(x.text) for x in got) == ["None", "also nothing", "nothing of the kind"]
