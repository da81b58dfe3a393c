"""Table scans with tenant scope, snapshots, JDBC, JSON documents in and out, and idempotent seeding."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import TenantContext, scope
from ..schema import TABLES


def scan(spark: SparkSession, root: str, name: str, ctx: TenantContext | None = None, scoped: bool | None = None) -> DataFrame:
    """A domain table under root; scoped tables keep the context's rows, others all (scoped=True scopes them as well)."""
    table = TABLES[name]
    df = spark.read.schema(table.struct).parquet(f"{root}/{name}")
    use = table.scoped if scoped is None else scoped
    return scope(df, ctx) if use else df


def jdbc(spark: SparkSession, url: str, name: str, ctx: TenantContext | None = None, partition_on: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table of a relational database. partition_on is (column, lower, upper, partitions) for a parallel read."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if partition_on:
        column, low, high, n = partition_on
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    df = reader.load()
    return scope(df, ctx) if name in TABLES and TABLES[name].scoped else df


def snapshot(state: dict[str, DataFrame], root: str, overwrite: bool = False) -> None:
    """Write every table of the state under root. Without overwrite an existing snapshot is an error."""
    for name, df in state.items():
        df.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{root}/{name}")


def restore(spark: SparkSession, root: str, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot, with the declared schemas."""
    return {n: scan(spark, root, n) for n in (names or TABLES)}


def read_documents(spark: SparkSession, path: str, schema: str, allowed: Iterable[str]) -> DataFrame:
    """JSON request documents with the allowed columns only; malformed ones have null columns."""
    return spark.read.schema(schema).json(path).select(*allowed)


def to_documents(df: DataFrame, wrapped: bool = True) -> DataFrame:
    """One JSON document for each row, in a ``data`` member or bare; null members are kept."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.to_json(F.struct(row.alias("data")) if wrapped else row, {"ignoreNullFields": "false"}).alias("document"))


def first_or_create(current: DataFrame, wanted: DataFrame, match: list[str]) -> DataFrame:
    """current and those rows of wanted whose match columns occur in no row of current; repeated wanted rows count once."""
    new = wanted.dropDuplicates(match).join(current.select(*match), match, "left_anti")
    return current.unionByName(new, allowMissingColumns=True)


def has_columns(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def visible(df: DataFrame, name: str) -> DataFrame:
    """A table's rows as they may be shown: without its hidden columns."""
    return df.drop(*TABLES[name].hidden)
