"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import bpe, decontaminate, html_text, lang_id, near_dup, near_vectors, pii, quality, sharding, toxicity
from keyloom.llm.common import crc_mod, table, thinned


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; digests of the ids and of the decoded bytes."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded_text", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item or an edited copy of one, with the item and where."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies, and whether it is the one that stays."""
    return near_dup.classes(table(spark, sf_dir, "documents")).drop("text_hash")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law of near equal bytes."""
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's number of near vectors and its component."""
    return near_vectors.link(table(spark, sf_dir, "embeddings"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document, counted and digested."""
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.BASE),
        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learnt from documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = lang_id.train(docs.where(crc_mod("doc_id", 3) != 1))
    return lang_id.identify(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def _labelled(docs: DataFrame, labels: DataFrame, name: str, m: int, held_out: int, about: int) -> tuple[DataFrame, dict[int, int]]:
    """Labelled texts outside the held-out fold to choose a sample from, and how many ids have labels of each kind.

    Labels are thinned first, by a hash of the id, to ``about`` distinct ids of each of the two
    kinds: so few that they are sent to the texts, and no text is shuffled. Only the sample depends on that.
    """
    rows = labels.select("doc_id", F.col(name).cast("int").alias(name)).where(F.col("doc_id").isNotNull() & F.col(name).isin(0, 1) & (crc_mod("doc_id", m) != held_out))
    counts = {r[name]: r["n"] for r in rows.groupBy(name).agg(F.approx_count_distinct("doc_id", 0.01).alias("n")).collect()}
    few = rows.where(thinned(F.col(name), F.xxhash64("doc_id"), counts, about)).distinct()
    return docs.select("doc_id", "text", "lang").join(F.broadcast(few), "doc_id"), counts


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; labels learnt from outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    rows, _ = _labelled(docs, table(spark, sf_dir, "labels"), "toxic", 5, 0, 6_000)
    model = toxicity.train(rows, F.col("toxic"), 300)
    return toxicity.score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; labels learnt from outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    rows, counts = _labelled(docs, table(spark, sf_dir, "labels"), "quality", 4, 2, 10_000)
    model = quality.train(docs, rows, F.col("quality"), 2_500, counts=counts)
    return quality.score(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_html_text": op2_html_text,
    "op3_decontamination": op3_decontamination,
    "op4_near_dup": op4_near_dup,
    "op5_sharding": op5_sharding,
    "op6_near_vectors": op6_near_vectors,
    "op7_pii": op7_pii,
    "op8_language_id": op8_language_id,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
}

#: Groups of equal texts in order of their MD5; a recursive binary search over capacities, each checked by a fold.
_OP5 = """WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size, CAST('0x' || substr(md5(t), 1, 15) AS BIGINT) AS key, t FROM d),
g AS (SELECT key, CAST(sum(size) AS BIGINT) AS size FROM k GROUP BY key),
r AS (SELECT key, size, CAST(sum(size) OVER (ORDER BY key) AS BIGINT) AS upto FROM g),
s AS (SELECT list({'n': CAST(1 AS BIGINT), 'run': size} ORDER BY key) AS groups, CAST(max(size) AS BIGINT) AS most, CAST(sum(size) AS BIGINT) AS total, CAST(8 AS BIGINT) AS shards FROM r),
b AS (SELECT CAST(greatest(most, (total + shards - 1) // shards) AS BIGINT) AS lo, total AS hi FROM s
 UNION ALL SELECT CASE WHEN fits THEN lo ELSE mid + 1 END, CASE WHEN fits THEN mid ELSE hi END FROM
 (SELECT lo, hi, mid, list_reduce(s.groups, lambda a, x: CASE WHEN a.run + x.run > mid THEN {'n': a.n + 1, 'run': x.run} ELSE {'n': a.n, 'run': a.run + x.run} END).n <= s.shards AS fits FROM (SELECT lo, hi, (lo + hi) // 2 AS mid FROM b WHERE lo < hi), s)),
c AS (SELECT min(hi) AS cap FROM b),
e AS (SELECT CAST(0 AS BIGINT) AS upto UNION ALL SELECT (SELECT max(r.upto) FROM r, c WHERE r.upto <= e.upto + c.cap) FROM e WHERE e.upto < (SELECT total FROM s)),
p AS (SELECT r.key, CAST((SELECT count(*) FROM e WHERE e.upto > 0 AND e.upto < r.upto) AS INTEGER) AS shard FROM r)
SELECT doc_id, size, {crc} AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM k JOIN p USING (key)"""



def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, folded over their hex digits, low digit of a byte first."""
    table = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    digits = f"list_transform(list_filter(string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'), ''), lambda h: h <> ''), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda a, y: xor(a >> 4, {table}[CAST((xor(a, y) & 15) + 1 AS INTEGER)])), 4294967295)"


_OP6 = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
n AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS r FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.r * b.r) >= 0.95),
t AS (SELECT vec_id AS s, vec_id AS t FROM v UNION SELECT t.s, p.b FROM t JOIN p ON p.a = t.t),
c AS (SELECT s, min(t) AS component_id FROM t GROUP BY s), l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.s = v.vec_id LEFT JOIN l ON l.a = v.vec_id"""

#: The other operators are beyond SQL and are tested against brute force.
ORACLES: dict[str, str] = {"op5_sharding": _OP5.replace("{crc}", _crc32_sql("t")), "op6_near_vectors": _OP6}
