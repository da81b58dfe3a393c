"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp) for every id of ``links`` (a, b): comp is the smallest id that links reach.

    Each round points a node's larger neighbours at its smallest one, then its smaller neighbours likewise; the
    table never holds more rows than at the start, and long chains halve. Minima are partial aggregates, so a
    node with many links is no hot spot. Null ends and links of a node with itself are left out.
    """
    edges = scratch.write(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after_edges = scratch.write(small.select("e.*").filter(F.col("a") != F.col("b")).distinct())
        scratch.drop(edges)
        edges, after = after_edges, _state(after_edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(roots)
