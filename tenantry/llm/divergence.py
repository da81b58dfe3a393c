"""Source divergence audit: how far the word use of each source lies from the others of its language.

Each kept term of a language becomes one wide row: an array with the term's count at every source's place. Higher-order
functions turn counts into smoothed shares in whole billionths and emit, source by source, the differences to the
sources after it; partial sums in the map tasks leave one row for each pair and task to be shuffled. No Python runs.

Counts of a word that stands in every document are partial sums as well, so it is no hot spot. The table of sources is
broadcast only if its counted rows are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, table

#: ASCII letters and everything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of (language, source) that are broadcast at most.
MOST_GROUPS = 100_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_GROUPS else df


def _share(count: str, total: str) -> str:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), exact: in decimals of 38 digits."""
    return f"1 + (cast({count} + 5 as decimal(20,0)) * 1000000000BD) div cast({total} + 5 * terms as decimal(20,0))"


def wide_vectors(docs: DataFrame, min_docs: int = 30, lang: str = "lang", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """(vectors, groups, number of groups).

    groups has (lang, source, at, total, terms): each source's place in its language, its occurrences of kept terms
    and the language's number of kept terms. vectors has (lang, term, n, docs, shares, q), one row for each kept term:
    its count, the documents with it, an array of struct(n, p) by place and the language's own share q.

    Null texts, languages and sources are read as empty; a source without terms is a group with zero counts. Repeated
    rows count as often as they stand. Whole texts are read, however long; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    empty = F.lit("")
    own = docs.select(F.coalesce(F.col(f"`{lang}`"), empty).alias("lang"), F.coalesce(F.col(f"`{source}`"), empty).alias("source"), F.coalesce(F.col(f"`{text}`"), empty).alias("text"))
    by_name = Window.partitionBy("lang").orderBy("source")
    places = scratch.write(own.select("lang", "source").distinct().withColumn("at", F.row_number().over(by_name) - 1))
    n_groups = places.count()
    found = own.join(_small(places, n_groups), ["lang", "source"]).select("lang", "at", F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)).alias("found"))
    # every occurrence, and each term of the document once more: counts and documents in one pass
    sides = found.select("lang", "at", F.explode(F.array(F.struct(F.col("found").alias("terms"), F.lit(0).alias("doc")), F.struct(F.array_distinct("found").alias("terms"), F.lit(1).alias("doc")))).alias("s"))
    words = sides.select("lang", "at", F.col("s.doc").alias("doc"), F.explode("s.terms").alias("term"))
    counts = words.groupBy("lang", "term", "at").agg(F.sum(1 - F.col("doc")).alias("n"), F.sum("doc").alias("docs"))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("by_place")).filter(F.col("docs") >= min_docs)
    kept = scratch.write(kept)
    totals = kept.select("lang", F.explode("by_place").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    zero = F.lit(0).cast("long")
    groups = places.join(totals, ["lang", "at"], "left").join(terms, "lang", "left").select("lang", "source", "at", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms"))
    groups = scratch.write(groups)
    wide = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "total"))).alias("places"), F.sum("total").alias("lang_total"), F.max("terms").alias("terms"))
    shares = F.expr(f"transform(places, s -> named_struct('n', coalesce(by_place[s.at], 0L), 'p', {_share('coalesce(by_place[s.at], 0L)', 's.total')}))")
    vectors = kept.join(_small(wide, n_groups), "lang").select("lang", "term", "n", "docs", shares.alias("shares"), F.expr(_share("n", "lang_total")).alias("q"))
    return vectors, groups, n_groups


def pair_divergence(vectors: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """(lang, source, item, value): the sum of share differences of each two sources of a language; 0 without kept terms."""
    one = vectors.select("lang", "shares", F.posexplode("shares").alias("at", "own"))
    later = F.slice(F.col("shares"), F.col("at") + 2, F.size("shares"))
    emitted = F.transform(later, lambda other, k: F.struct((F.col("at") + k + 1).alias("other"), F.abs(F.col("own.p") - other["p"]).alias("f")))
    sums = one.select("lang", "at", F.explode(emitted).alias("e")).groupBy("lang", "at", F.col("e.other").alias("other")).agg(F.sum("e.f").alias("f"))
    both = sums.unionByName(sums.select("lang", F.col("other").alias("at"), F.col("at").alias("other"), "f"))
    a = groups.select("lang", "source", "at")
    b = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("other"))
    pairs = _small(a, n_groups).join(b, "lang").filter(F.col("at") != F.col("other"))  # the rows of the result
    return pairs.join(both, ["lang", "at", "other"], "left").select("lang", "source", "item", F.coalesce("f", F.lit(0).cast("long")).alias("value"))


def top_terms(vectors: DataFrame, groups: DataFrame, n_groups: int, k: int = 50) -> DataFrame:
    """(lang, source, item, value, rank): the ``k`` terms of each source whose share exceeds the language's most."""
    each = vectors.select("lang", "term", "q", F.posexplode("shares").alias("at", "own")).filter((F.col("own.n") > 0) & (F.col("own.p") > F.col("q")))
    each = each.select("lang", "at", F.col("term").alias("item"), (F.col("own.p") - F.col("q")).alias("value"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "at").orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= k)
    return ranked.join(_small(groups.select("lang", "source", "at"), n_groups), ["lang", "at"]).select("lang", "source", "item", "value", "rank")


def divergence_audit(docs: DataFrame, min_docs: int = 30, k: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has a language's other sources, ``term`` a source's own terms.

    See wide_vectors for nulls, repeated rows and long texts. Equal values are ranked by item. An empty table gives no rows.
    """
    vectors, groups, n_groups = wide_vectors(docs, min_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_divergence(vectors, groups, n_groups).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    terms = top_terms(vectors, groups, n_groups, k).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), words AS (
  SELECT d, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30
), counts AS (
  SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c FROM groups g JOIN kept k USING (lang) LEFT JOIN counts USING (lang, source, term)
), langs AS (
  SELECT lang, term, sum(c) AS c FROM dense GROUP BY lang, term
), p AS (
  SELECT *, (1 + (1000000000::HUGEINT * (c + 5)::HUGEINT) // (sum(c) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source))::HUGEINT)::BIGINT AS p FROM dense
), q AS (
  SELECT *, (1 + (1000000000::HUGEINT * (c + 5)::HUGEINT) // (sum(c) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang))::HUGEINT)::BIGINT AS q FROM langs
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= 50
"""
