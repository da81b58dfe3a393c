"""Relations as joins: lookups, children, many-to-many links with attributes, existence tests and nested results.

Children are nested by one grouping of the link table, not by one query a row. Nested arrays are sorted, so results
do not depend on partitioning. No join strategy is forced: adaptive execution broadcasts a side by its size.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import TenantContext, tenant_condition


def belongs_to(df: DataFrame, parent: DataFrame, key: str, name: str, parent_key: str = "id", ctx: TenantContext | None = None, tenant: str = "tenant_id") -> DataFrame:
    """df with its parent row as struct column ``name``, null where there is none.

    A context restricts the parent's side within the join condition, so rows whose parent belongs to another tenant
    stay, with a null parent. A null key has no parent.
    """
    side = parent.select(F.col(parent_key).alias("__key"), F.struct(*[F.col(c) for c in parent.columns]).alias(name))
    on = F.col(key) == F.col("__key")
    if ctx is not None:
        on = on & tenant_condition(ctx, F.col(f"{name}.{tenant}"))
    return df.join(side, on, "left").drop("__key")


def nested_children(df: DataFrame, children: DataFrame, key: str, fields: list[str], name: str, own_key: str = "id") -> DataFrame:
    """df with ``name``: the sorted array of its children's fields, empty where there are none."""
    nested = children.groupBy(F.col(key).alias("__key")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    out = df.join(nested, F.col(own_key) == F.col("__key"), "left").drop("__key")
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(nested.schema[name].dataType)))


def through(left: DataFrame, pivot: DataFrame, right: DataFrame, left_on: tuple[str, str], right_on: tuple[str, str], pivot_fields: list[str] = [], right_filter: Column | None = None) -> DataFrame:  # noqa: B006
    """left and right joined through pivot, one row for each pivot row; pivot_fields stay in the struct ``pivot``.

    left_on is (column of left, column of pivot), right_on is (column of pivot, column of right). right_filter is a
    condition on columns of right, applied before the join. Columns of right that clash with left's are prefixed
    with ``related_``.
    """
    far = right if right_filter is None else right.filter(right_filter)
    far = far.select(*[F.col(c).alias(f"related_{c}" if c in left.columns else c) for c in far.columns])
    right_key = f"related_{right_on[1]}" if right_on[1] in left.columns else right_on[1]
    link = pivot.select(F.col(left_on[1]).alias("__l"), F.col(right_on[0]).alias("__r"), *([F.struct(*pivot_fields).alias("pivot")] if pivot_fields else []))
    return left.join(link, F.col(left_on[0]) == F.col("__l")).join(far, F.col("__r") == F.col(right_key)).drop("__l", "__r")


def where_has(df: DataFrame, related: DataFrame, key: str, related_key: str = "id", condition: Column | None = None) -> DataFrame:
    """Rows with at least one related row that meets the condition."""
    side = (related if condition is None else related.filter(condition)).select(F.col(related_key).alias("__key"))
    return df.join(side, F.col(key) == F.col("__key"), "left_semi")


def doesnt_have(df: DataFrame, related: DataFrame, key: str, related_key: str = "id") -> DataFrame:
    """Rows without a related row; a null key has none."""
    return df.join(related.select(F.col(related_key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")


def with_parent(df: DataFrame, key: str = "parent_id", fields: tuple[str, ...] = ("id", "name")) -> DataFrame:
    """A hierarchy's rows with their direct parent's fields in the struct ``parent``."""
    parent = df.select(F.col("id").alias("__key"), F.struct(*fields).alias("parent"))
    return df.join(parent, F.col(key) == F.col("__key"), "left").drop("__key")


def all_present(requested: DataFrame, valid: DataFrame, group: str, item: str) -> DataFrame:
    """(group, all_present): whether every distinct item that a group requests is valid. Null items are never valid."""
    known = valid.select(F.col(item)).distinct().withColumn("__known", F.lit(True))
    return requested.select(group, item).distinct().join(known, item, "left").groupBy(group).agg(F.min(F.coalesce("__known", F.lit(False))).alias("all_present"))


def find(df: DataFrame, key: int, column: str = "id") -> DataFrame:
    """The row with the key; an error where there is none."""
    found = df.filter(F.col(column) == key)
    if found.isEmpty():
        raise LookupError(f"no row with {column} = {key}")
    return found


def first_by(df: DataFrame, *order: str) -> DataFrame:
    """The first row by a stated order."""
    return df.orderBy(*order).limit(1)


def first_or_fail(df: DataFrame, *order: str) -> DataFrame:
    """The first row by a stated order; an error where there is none."""
    found = first_by(df, *order)
    if found.isEmpty():
        raise LookupError("no row")
    return found


def where_all(df: DataFrame, *conditions: Column) -> DataFrame:
    return df.filter(functools.reduce(lambda a, b: a & b, conditions)) if conditions else df
