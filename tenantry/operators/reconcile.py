"""Set reconciliation of link tables: sync, attach, detach, update, replace and dedupe, each giving the new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sync_diff(current: DataFrame, desired: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, action): attach, detach or keep for every link of either side; repeated links count once, null keys match."""
    a = current.select(*keys).distinct().withColumn("__c", F.lit(True))
    b = desired.select(*keys).distinct().withColumn("__d", F.lit(True))
    both = a.unionByName(b, allowMissingColumns=True).groupBy(*keys).agg(F.max("__c").alias("c"), F.max("__d").alias("d"))
    return both.select(*keys, F.when(F.col("c").isNull(), "attach").when(F.col("d").isNull(), "detach").otherwise("keep").alias("action"))


def sync(current: DataFrame, desired: DataFrame, owner: str, item: str, owners: DataFrame | None = None) -> DataFrame:
    """The links after each owner's were set to the desired ones. Kept links keep their attributes.

    Only owners named in ``owners`` (or, without it, in desired) are touched; an owner in owners without desired
    links loses all.
    """
    touched = (owners if owners is not None else desired).select(owner).distinct()
    wanted = desired.select(owner, item).distinct().join(touched, owner, "left_semi")
    mine = current.join(touched, owner, "left_semi")
    new = wanted.join(mine.select(owner, item), [owner, item], "left_anti")
    return current.join(touched, owner, "left_anti").unionByName(mine.join(wanted, [owner, item], "left_semi")).unionByName(new, allowMissingColumns=True)


def attach_if_absent(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return current.unionByName(new.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def attach(current: DataFrame, new: DataFrame) -> DataFrame:
    """A blind insert; check uniqueness with operators.rules.duplicates."""
    return current.unionByName(new, allowMissingColumns=True)


def detach(current: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Without all rows of the pairs, whatever their other columns."""
    return current.join(pairs.select(*keys).distinct(), keys, "left_anti")


def update_pivot(current: DataFrame, changes: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """All rows of a changed pair take the given fields, nulls included; of repeated changes one must remain: the least."""
    best = changes.groupBy(*keys).agg(F.min(F.struct(*fields)).alias("__new"))
    joined = current.join(best, keys, "left")
    new = {f: F.when(F.col("__new").isNotNull(), F.col(f"__new.{f}")).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(new).select(*current.columns)


def replace_children(current: DataFrame, new: DataFrame, owner: str, item: str, owners: DataFrame | None = None) -> DataFrame:
    """Owners' children deleted and the distinct new ones inserted."""
    touched = (owners if owners is not None else new).select(owner).distinct()
    return current.join(touched, owner, "left_anti").unionByName(new.dropDuplicates([owner, item]), allowMissingColumns=True)


def dedupe_keep_min(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """For each group the row that is least by order, as one aggregate: partial minima before the shuffle."""
    rest = [c for c in df.columns if c not in group and c not in order]
    least = df.groupBy(*group).agg(F.min(F.struct(*order, *rest)).alias("__m"))
    return least.select(*group, "__m.*").select(*df.columns)


def dedupe_ranked(df: DataFrame, group: list[str], order: list[str | Column]) -> DataFrame:
    """As dedupe_keep_min, for rows with columns that have no order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter("__r = 1").drop("__r")
