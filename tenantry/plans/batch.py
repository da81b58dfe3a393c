"""Batches of patches: requests as a table, folded per row in request order, with violations for each request.

Any number of requests is one plan: each column's last value is a maximum over (request, value), a partial sum before
the shuffle, so a row that most requests patch is no hot spot.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.collation import collated_keys
from ..operators.skew import lookup
from ..schema import TABLES
from ..sources.workspace import Workspace

State = dict[str, DataFrame]
FIXED = ("id", "tenant_id", "created_at", "updated_at")


def _fold(requests: DataFrame, columns: list[str], struct) -> DataFrame:
    """(id, last, one column of struct(request, value) for each patched column): null where no request has the column."""
    last = {c: F.max(F.when(F.map_contains_key("changes", c), F.struct("request", F.try_element_at("changes", F.lit(c)).try_cast(struct[c].dataType).alias("value")))).alias(f"__new_{c}") for c in columns}
    return requests.groupBy(F.col("id").alias("__id")).agg(F.max("request").alias("__last"), *last.values())


def _applied(table: DataFrame, folded: DataFrame, columns: list[str], at: Column | None) -> DataFrame:
    """The table with the folded values, and ``__last``, the last request of each changed row."""
    joined = table.join(folded, F.col("id") == F.col("__id"), "left")
    new = {c: F.when(F.col(f"__new_{c}").isNotNull(), F.col(f"__new_{c}.value")).otherwise(F.col(c)) for c in columns}
    if at is not None:
        new["updated_at"] = F.when(F.col("__last").isNotNull(), at).otherwise(F.col("updated_at"))
    return joined.withColumns(new).select(*table.columns, "__last", *[F.col(f"__new_{c}").isNotNull().alias(f"__set_{c}") for c in columns])


def _broken(rows: DataFrame, rule: str | Column, detail: Column) -> DataFrame:
    return rows.select("request", (F.lit(rule) if isinstance(rule, str) else rule).alias("rule_id"), F.col("id").alias("entity_id"), detail.cast("string").alias("detail"))


def patch(state: State, name: str, requests: DataFrame, at: Column | None = None) -> tuple[State, DataFrame]:
    """(new state, violations) after the requests (request, tenant_id, id, changes) on one table.

    changes is a map from columns to new values as text: a member that is there replaces the old value, null included,
    one that is not leaves it. Ids, tenants and timestamps cannot be patched; ``at`` is the new updated_at of changed
    rows. A null tenant_id stands for no context.

    violations has (request, rule_id, entity_id, detail). A request with one has no effect and the others have theirs, in the
    order of their numbers: unknown rows, rows of another tenant, unknown columns, values that the type or the domain does not
    hold, references to no row, a row as its own parent, and taken keys. A key is taken if a row that no request changes
    has it, or a row whose last request is smaller; so of several rows that claim a key the earliest keeps it. Requests
    that free a key do not help others in the same batch. Of equal request numbers the greatest value counts. Keys are
    compared as the table's collation does.
    """
    table, struct, work = TABLES[name], TABLES[name].struct, Workspace(requests.sparkSession)
    columns = [f.name for f in struct if f.name not in FIXED]
    current = state[name].withColumn("tenant_id", F.lit(None).cast("long")) if "tenant_id" not in struct.names else state[name]
    owners = current.select("id", F.col("tenant_id").alias("__owner"), F.lit(True).alias("__there"))
    asked = work.write(lookup(requests.select("request", "tenant_id", "id", "changes"), owners, "id", "left", "request"))

    value = lambda c: F.try_element_at("changes", F.lit(c))
    rules: list[tuple[Column, str, Column]] = [(F.col("__there").isNull(), f"{name}.id.exists", F.col("id"))]
    if table.scoped:
        rules.append((F.col("__there") & F.col("tenant_id").isNotNull() & ~F.col("tenant_id").eqNullSafe(F.col("__owner")), f"{name}.tenant", F.col("tenant_id")))
    unknown = F.array_except(F.map_keys("changes"), F.array(*[F.lit(c) for c in columns]))
    rules.append((F.size(unknown) > 0, f"{name}.columns", F.array_join(F.array_sort(unknown), ",")))
    for c in columns:
        if struct[c].dataType.typeName() != "string":
            rules.append((value(c).isNotNull() & value(c).try_cast(struct[c].dataType).isNull(), f"{name}.{c}.type", value(c)))
    for c, allowed in table.domains.items():
        rules.append((value(c).isNotNull() & ~value(c).isin(*allowed), f"{name}.{c}.in", value(c)))
    if "parent_id" in columns:
        rules.append((value("parent_id").try_cast("long") == F.col("id"), "self_parent", value("parent_id")))
    each = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(rule).alias("rule_id"), detail.cast("string").alias("detail"))) for bad, rule, detail in rules]))
    found = [asked.select("request", "id", F.explode(each).alias("v")).select("request", F.col("v.rule_id").alias("rule_id"), F.col("id").alias("entity_id"), F.col("v.detail").alias("detail"))]
    for r in table.references:
        if r.column in columns and r.parent in state:
            named = asked.select("request", "id", value(r.column).try_cast("long").alias("__p")).filter("__p is not null")
            there = state[r.parent].select(F.col(r.parent_key).alias("__p"), F.lit(True).alias("__known")).distinct()
            found.append(_broken(lookup(named, there, "__p", "left", "request").filter("__known is null"), f"{name}.{r.column}.exists", F.concat_ws("=", F.lit(r.column), F.col("__p"))))
    broken = work.write(functools.reduce(DataFrame.unionByName, found))
    while True:
        standing = asked.join(broken.select("request").distinct(), "request", "left_anti")
        new = _applied(state[name], _fold(standing, columns, struct), columns, at if "updated_at" in struct.names else None)
        lost = [df for u in table.unique if set(u) & set(columns) and (df := _taken(new, standing, name, u, columns)) is not None]
        if not lost:
            break
        more = work.write(functools.reduce(DataFrame.unionByName, lost))
        if more.isEmpty():
            break
        broken = work.write(broken.unionByName(more))
    return state | {name: new.select(*state[name].columns)}, broken


def _taken(new: DataFrame, requests: DataFrame, name: str, unique: tuple[str, ...], columns: list[str]) -> DataFrame | None:
    """The requests that give a row a key of another one: those of rows which set a column of it and are not the first to hold it."""
    setters = [c for c in unique if c in columns]
    rows = collated_keys(new, list(unique)).filter(functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in unique]))
    claims = functools.reduce(lambda a, b: a | b, [F.col(f"__set_{c}") for c in setters])
    rows = rows.select("id", *unique, F.when(claims, F.col("__last")).alias("__claim"))
    # rows that hold the key without a claim come first, then the earliest claim
    first = rows.groupBy(*unique).agg(F.min(F.struct(F.col("__claim").isNotNull().alias("c"), F.col("__claim").alias("r"), F.col("id").alias("i"))).alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    losers = rows.join(first, list(unique)).filter(F.col("__claim").isNotNull() & (F.col("id") != F.col("__first.i"))).select(F.col("id").alias("__loser"), F.concat_ws("|", *[F.col(c).cast("string") for c in unique]).alias("__key"))
    touching = requests.filter(functools.reduce(lambda a, b: a | b, [F.map_contains_key("changes", c) for c in setters]))
    hit = touching.join(losers, F.col("id") == F.col("__loser"))
    return _broken(hit, f"{name}.{'_'.join(unique)}.unique", F.col("__key"))
