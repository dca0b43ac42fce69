"""Documents to tokens in five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

Every stage works on all that its predecessor kept, and its decisions take effect:

1. language_id: documents without any letters, whose language cannot be told, go.
2. near_dup: of each class of exact and near copies the document with the smallest id stays.
3. decontamination: documents that hold a benchmark item, or an edited copy of one, go.
4. pii: personal data is replaced by its kind in brackets, and n_chars counted anew.
5. byte_bpe: every text is encoded and decoded; the ids and the decoded text are added.

Defined results, for each stage on its own: empty tables give empty ones; only the columns of ``documents`` are
read and returned, whatever other columns are named; whole texts count, whatever their length; null lang, source and
n_chars pass on. A null or empty text goes in stage 1 and passes the others, where it has no copies, items or
spans and no tokens. Rows without an id are judged by their text in stages 1 and 3, stay in stage 2, and are
redacted and encoded in 4 and 5. Of repeated rows stage 2 keeps one; the others treat each alike. Of rows that
share an id but not the text each is a document of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import bpe, decontaminate, lang_id, near_dup, pii
from keyloom.llm.common import crc_mod, ensure_checkpoint_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that was identified from their text."""
    model = lang_id.train(docs.where(crc_mod("doc_id", 3) != 1))
    return lang_id.identify(docs.select(COLUMNS), model).where(F.col("lang_pred") != "und").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies, and one of repeated rows; rows without an id or a text stay.

    Rows that share an id but not the text are documents of their own: the decision goes by id and
    text. The join deals rows by both already, so repeated rows meet without another shuffle.
    """
    rows = docs.select(COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    kept = near_dup.classes(docs).where("kept").select("doc_id", "text_hash").distinct()
    one = rows.join(kept, ["doc_id", "text_hash"], "left_semi").where("text IS NOT NULL").dropDuplicates(["doc_id", "text_hash"])
    return one.select(COLUMNS).union(docs.where(F.col("doc_id").isNull() | F.col("text").isNull()).select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark item, rows without an id among them. No join."""
    return decontaminate.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data; null texts stay null. One row in, one row out, no join."""
    spans = F.array_sort(F.concat("base", "added"))
    out = pii.find(docs, keep_text=True, carry=("lang", "source", "n_chars", F.col("text").isNull().alias("no_text")))
    out = pii.redacted(out.withColumn("spans", spans), "text", "spans", "clean").withColumn("hit", F.size("spans") > 0)
    text = F.when(~F.col("no_text"), F.col("clean"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("hit"), F.length("clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add token ids and the text that they decode to."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.encode_decode(docs.select(COLUMNS), ranks, public_tokenizers.PATTERN, carry=tuple(COLUMNS[1:]))
    return out.select(*COLUMNS, "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded_text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dup", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("byte_bpe", byte_bpe),
]

#: Suffix automata, registers, alignment and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``; between stages rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    ensure_checkpoint_dir(spark)
    own = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"  # results may be read after the next run
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{own}/{i}")
            docs = spark.read.parquet(f"{own}/{i}")
    return docs
