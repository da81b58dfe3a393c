"""Who reads: a tenant, or explicitly everyone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TenantContext:
    tenant_id: int


def tenant_condition(ctx: TenantContext | None, column: Column) -> Column:
    """For ON clauses: true for every row without a context. A row whose tenant is null belongs to no context."""
    return F.lit(True) if ctx is None else column == F.lit(ctx.tenant_id)


def scope(df: DataFrame, ctx: TenantContext | None, column: str = "tenant_id") -> DataFrame:
    """The tenant's rows; all rows if the context is None."""
    return df if ctx is None else df.filter(tenant_condition(ctx, F.col(column)))


def require(ctx: TenantContext | None) -> TenantContext:
    if ctx is None:
        raise PermissionError("a tenant context is required")
    return ctx
