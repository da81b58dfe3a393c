"""Tenant-scoped streams: an extension, as the data model itself has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import TenantContext, scope


def stream_table(spark: SparkSession, path: str, schema: str, ctx: TenantContext | None = None, column: str = "tenant_id") -> DataFrame:
    """New Parquet files of a folder as a stream of the tenant's rows."""
    return scope(spark.readStream.schema(schema).parquet(path), ctx, column)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows per window and key; state older than the lateness bound is dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")
