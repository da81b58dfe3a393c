"""Tables laid out by tenant: a context prunes folders, and a bulk change rewrites the folders of its tenants only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import TenantContext, scope
from ..schema import TABLES
from .workspace import Workspace, hadoop_path

#: Rows whose tenant is null lie in the folder of this name.
NO_TENANT = "__HIVE_DEFAULT_PARTITION__"


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lay a scoped table out by tenant. Rows are rebalanced by tenant: small tenants share tasks, a large one is split over many."""
    df.hint("rebalance", "tenant_id").write.partitionBy("tenant_id").mode(mode).parquet(path)


def scan(spark: SparkSession, path: str, name: str, ctx: TenantContext | None = None) -> DataFrame:
    """A table laid out by tenant; a context reads its tenant's folder and lists no other rows."""
    struct = TABLES[name].struct
    return scope(spark.read.schema(struct).parquet(path), ctx).select(*struct.names)


def _rewrite(spark: SparkSession, path: str, tenants: list[int | None], rows: DataFrame) -> None:
    """Replace the folders of these tenants by the rows. A tenant left without rows loses its folder.

    The rows may be read from the same path: a dynamic overwrite moves its new files in after all have been written.
    """
    staged = Workspace(spark)
    new = staged.write(rows)
    left = {r["tenant_id"] for r in new.select("tenant_id").distinct().collect()}  # some of the tenants' folders
    new.hint("rebalance", "tenant_id").write.partitionBy("tenant_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    for t in tenants:
        if t not in left:
            folder, fs = hadoop_path(spark, f"{path}/tenant_id={NO_TENANT if t is None else t}")
            fs.delete(folder, True)
    staged.drop(new)


def _touched(df: DataFrame, condition: Column) -> list[int | None]:
    """The tenants with a row that meets the condition: at most as many as the table has folders, which the driver lists anyway."""
    return [r["tenant_id"] for r in df.filter(condition).select("tenant_id").distinct().collect()]


def _of(df: DataFrame, tenants: list[int | None]) -> DataFrame:
    named = [t for t in tenants if t is not None]
    hit = F.col("tenant_id").isin(named) if named else F.lit(False)
    return df.filter(hit | F.col("tenant_id").isNull() if None in tenants else hit)


def update_where(spark: SparkSession, path: str, name: str, condition: Column, changes: dict, ctx: TenantContext | None = None) -> list[int | None]:
    """Patch the rows for which the condition holds, within the context; the tenants whose folders were rewritten.

    Values may be columns. Ids and tenants stay. A condition that is null for a row does not hold.
    """
    df = scan(spark, path, name, ctx)
    tenants = _touched(df, condition)
    if tenants:
        which = F.coalesce(condition, F.lit(False))
        kept = {c: v for c, v in changes.items() if c not in ("id", "tenant_id")}
        new = {c: F.when(which, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in kept.items()}
        _rewrite(spark, path, tenants, _of(df, tenants).withColumns(new) if new else _of(df, tenants))
    return tenants


def delete_where(spark: SparkSession, path: str, name: str, condition: Column, ctx: TenantContext | None = None) -> list[int | None]:
    """Delete the rows for which the condition holds, within the context; the tenants whose folders were rewritten."""
    df = scan(spark, path, name, ctx)
    tenants = _touched(df, condition)
    if tenants:
        _rewrite(spark, path, tenants, _of(df, tenants).filter(~F.coalesce(condition, F.lit(False))))
    return tenants
