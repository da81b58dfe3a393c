"""Generated ids: dense, in a stated order, equal whatever the partitions, and without a pass through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import Workspace


def allocate(rows: DataFrame, after: int, order: list[str], id_col: str = "id") -> DataFrame:
    """rows with ids after + 1, after + 2, ... by ``order``, then by all other columns; equal rows take ids one after another.

    Rows are dealt out and sorted by range and written; an id is the place in the partition and the sizes of the
    partitions before it. Only these sizes, one row for each partition, meet in one task. A column that is named as
    the id is replaced.
    """
    columns = [c for c in rows.columns if c != id_col]
    keys = [F.col(f"`{c}`") for c in [*order, *[c for c in columns if c not in order]]]
    placed = Workspace(rows.sparkSession).write(
        rows.select(*[F.col(f"`{c}`") for c in columns]).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(offsets, "__part").select((F.lit(after + 1) + F.col("__before") + place).cast("long").alias(id_col), *[F.col(f"`{c}`") for c in columns])


def last_id(df: DataFrame, id_col: str = "id") -> int:
    """The largest id, 0 in an empty table."""
    return df.agg(F.max(id_col)).first()[0] or 0


def insert(current: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """current and the rows under new ids above its largest one; columns that rows lack are null."""
    return current.unionByName(allocate(rows, last_id(current), order), allowMissingColumns=True)


def first_or_create(current: DataFrame, wanted: DataFrame, match: list[str]) -> DataFrame:
    """current and, under new ids, those of wanted whose match columns no row has; of repeated wanted rows the least counts."""
    rest = [c for c in wanted.columns if c not in match and c != "id"]
    least = wanted.groupBy(*match).agg(F.min(F.struct(*rest)).alias("__rest")).select(*match, "__rest.*") if rest else wanted.select(*match).distinct()
    held = current.select(*[F.col(c).alias(f"__{c}") for c in match])
    same = F.lit(True)
    for c in match:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return insert(current, least.join(held, same, "left_anti"), match)
