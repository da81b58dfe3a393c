"""Hierarchies of any depth by pointer doubling: the rounds grow with the logarithm of the depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import Workspace
from .skew import lookup


def resolve(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(id, root, depth) for every row: its topmost ancestor and the steps to it; both null on and below a cycle.

    A row without a parent, or whose parent is no row, is a root of depth 0. Each round replaces a row's pointer by
    the pointer of the row it points at, so pointers reach twice as far; rows that have reached a root rest. The
    number of rows under way falls in each round as long as one of them has a root: after rounds of length 2^k those
    with at least 2^k steps are left, and an ancestor of each has just that many. So when it stays, only cycles are
    left. Rows are written after each round, which cuts lineage. Many rows that point at one are dealt out.

    Null ids are left out; of rows with one id the smallest parent counts. An empty table gives no rows.
    """
    work = Workspace(df.sparkSession)
    rows = df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(parent_col).alias("up"))
    rows = work.write(rows)
    known = rows.select(F.col("id").alias("up"), F.lit(True).alias("there"))
    linked = lookup(rows, known, "up", spread="id")
    table = work.write(linked.select("id", F.when(F.col("there"), F.col("up")).otherwise(F.col("id")).alias("at"), F.coalesce("there", F.lit(False)).alias("open"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("hops")))
    work.drop(rows)
    under_way = table.filter("open").count()
    while under_way:
        side = table.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("open").alias("more"), F.col("hops").alias("far"))
        moved = lookup(table.filter("open"), side, "at", "inner", spread="id").select("id", F.col("next").alias("at"), F.col("more").alias("open"), (F.col("hops") + F.col("far")).alias("hops"))
        after = work.write(table.filter("not open").unionByName(moved))
        work.drop(table)
        table, before, under_way = after, under_way, after.filter("open").count()
        if under_way == before:
            break
    return table.select("id", F.when(~F.col("open"), F.col("at")).alias("root"), F.when(~F.col("open"), F.col("hops")).alias("depth"))
