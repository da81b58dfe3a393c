"""Deletes with referential actions: cascade, restrict and set null, as a pure function of the state."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TABLES
from .rules import violations

#: Parents before children.
ORDER = ["tenants", "organizations", "business_entities", "companies", "contractors", "organization_companies", "locations", "operational_regions", "location_business_entities", "brands", "company_brands", "location_business_entity_brands", "user_organizations", "roles", "model_has_roles"]


def delete(state: dict[str, DataFrame], name: str, ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(new state, violations) after deleting the rows of table ``name`` whose id is in ids (column id).

    Restricting references of rows that are not deleted themselves are violations; the caller then keeps the old state.
    """
    return delete_keys(state, name, ids)[:2]


def delete_keys(state: dict[str, DataFrame], name: str, ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, dict[str, DataFrame]]:
    """As delete, with the keys of the rows that went from each table; no two states need be compared."""
    gone: dict[str, DataFrame] = {name: ids.select("id").distinct()}
    new, found, went = dict(state), [], {}
    for child in ORDER:
        if child not in state:
            continue
        df, keys = state[child], list(TABLES[child].key)
        hit = [df.join(gone[r.parent].select(F.col("id").alias(r.column)), r.column, "left_semi").select(*keys) for r in TABLES[child].references if r.on_delete == "cascade" and r.parent in gone]
        if child in gone:
            hit.append(gone[child])
        if hit:
            dropped = functools.reduce(DataFrame.unionByName, hit).distinct()
            went[child] = dropped
            if keys == ["id"]:
                gone[child] = dropped
            df = df.join(dropped, keys, "left_anti")
        for r in TABLES[child].references:
            if r.parent in gone and r.on_delete == "restrict":
                found.append(violations(df.join(gone[r.parent].select(F.col("id").alias(r.column)), r.column, "left_semi"), f"{child}.{r.column}.restrict", keys[0], F.concat_ws("=", F.lit(r.column), F.col(r.column))))
            if r.parent in gone and r.on_delete == "set_null":
                lost = gone[r.parent].select(F.col("id").alias("__lost"))
                df = df.join(lost, F.col(r.column) == F.col("__lost"), "left").withColumn(r.column, F.when(F.col("__lost").isNull(), F.col(r.column))).drop("__lost")
        new[child] = df
    empty = violations(ids.filter(F.lit(False)), "", "id", "")
    return new, functools.reduce(DataFrame.unionByName, found, empty), went
