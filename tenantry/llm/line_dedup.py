"""Line deduplication: lines that many documents share are dropped everywhere.

Lines are exploded with their position and two 64-bit hashes of the normalised line. Documents are counted
per hash (partial counts before the shuffle, so that a line in every document is no hot spot), the positions of
lines over the threshold are gathered per document and the text is reassembled from the other positions. Only
hashes and positions are shuffled for the counts; whole texts move once, in the join on the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Scratch, ascii_lower, table, whole_row

#: Shared lines that are broadcast at most (16 bytes each), and salts of the join beyond.
MOST_SHARED, SALTS = 1_000_000, 16


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop every line whose key occurs in at least ``min_docs`` documents.

    A line's key is the line stripped of white space at both ends with A-Z lower-cased; keys shorter than
    ``min_chars`` code points are never dropped. Returns the input's columns, the text replaced by the kept
    lines, with ``__n_lines`` (before) and ``__n_dropped`` added, which replace columns of these names.

    Null and empty texts are one empty line and give an empty text. Rows with equal id count as one document,
    a null id is a document of its own kind; each row keeps its own lines. Repeated rows all stay. Other columns pass through whatever their names. Whole texts
    are read, however long.
    """
    scratch, text = Scratch(docs.sparkSession), F.col("text")
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    # the input's columns lie in one struct, so that none clashes with those made here
    rows = docs.select(whole_row(docs), F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("own", F.xxhash64(F.lit(3), "text"))

    def key_of(line):
        return ascii_lower(F.btrim(line, F.lit(SPACES)))

    exploded = (
        rows.select("id", "own", F.posexplode(F.transform(lines, key_of)).alias("pos", "key"))
        .filter(F.length("key") >= max(min_chars, 1))
        .select("id", "own", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    exploded = scratch.write(exploded)
    counted = exploded.groupBy("h1", "h2").agg(F.count_distinct(F.struct("id")).alias("n")).filter(F.col("n") >= min_docs)
    shared = scratch.write(counted.select("h1", "h2"))
    if shared.count() <= MOST_SHARED:
        hit = exploded.join(F.broadcast(shared), ["h1", "h2"], "left_semi")
    else:  # a line may be in a third of all documents: its rows are dealt by salts
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = exploded.withColumn("salt", F.pmod(F.xxhash64("id", "own"), F.lit(SALTS)).cast("int")).join(salted, ["h1", "h2", "salt"], "left_semi")
    dropped = hit.groupBy(F.col("id").alias("drop_id"), F.col("own").alias("drop_own")).agg(F.collect_set("pos").alias("drop"))
    joined = rows.join(dropped, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("own") == F.col("drop_own")), "left")
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    out = joined.withColumn("lines", lines).withColumn("keep", F.when(F.col("drop").isNull(), every).otherwise(F.array_except(every, F.col("drop"))))
    kept = F.when(F.col("drop").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.transform("keep", lambda i: F.element_at("lines", i + 1)), "\n"))
    return out.select(
        *[kept.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c not in ("__n_lines", "__n_dropped")],
        F.size("lines").cast("long").alias("__n_lines"),
        (F.size("lines") - F.size("keep")).cast("long").alias("__n_dropped"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_shared_lines(docs).select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256")
    )


SQL = """
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), shared AS (
  SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), flagged AS (
  SELECT l.*, s.k IS NOT NULL AS gone FROM lines l LEFT JOIN shared s ON l.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
