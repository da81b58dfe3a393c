"""The corpus pipeline: quality classifier, line dedup, near-dedup, mixing and encoding, one after another.

Every stage works on all rows that its predecessor kept; all but the last return the columns of documents.

In every stage null texts are read as empty, other columns pass through whatever their names, whole texts are read, however
long, and an empty table gives an empty one. What a stage does with repeated rows and null ids stands with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenantry.llm import byte_bpe, line_dedup, minhash_dedup, mixing, quality_ranker
from tenantry.llm.common import Scratch, table, whole_row


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the ranker, fitted on the labelled ones, does not reject. Repeated rows and null ids are scored like others."""
    ranker = quality_ranker.fit_ranker(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality_ranker.score_documents(docs, ranker).filter("predicted = 1").select(*_columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more share; n_chars follows the text.

    Rows that share an id count as one document, those without an id as one as well; all rows stay.
    """
    kept = line_dedup.drop_shared_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates.

    Rows that share an id are one document. If it stays, one row of each of its texts stays. Rows without an id
    are compared with nothing and all stay.
    """
    verdict = minhash_dedup.near_duplicates(docs.select("doc_id", "text")).filter("kept")
    rows = verdict.groupBy(F.col("doc_id").alias("kept_id")).agg(F.count(F.lit(1)).alias("rows"))
    held = docs.select(whole_row(docs), F.col("doc_id").alias("id"), F.col("text").alias("text"))
    stay = held.join(rows, F.col("id").eqNullSafe(F.col("kept_id")))
    once = F.col("id").isNull() | (F.col("rows") == 1)
    texts = stay.filter(~once).withColumns({"a": F.xxhash64("text"), "b": F.xxhash64(F.lit(7), "text")}).dropDuplicates(["id", "a", "b"])
    return stay.filter(once).select("row.*").unionByName(texts.select("row.*"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them; see mix() for repeated rows, null ids and null sources."""
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens and digests of its ids and of the text they decode to."""
    import public_tokenizers

    encoded = byte_bpe.encode_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("minhash near-dedup", near_duplicates),
    ("mixing", mixture),
    ("byte-level bpe", encoding),
]
#: SQL cannot express the classifier, the random rounding or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each stage's result is written to the shared folder and read again."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
