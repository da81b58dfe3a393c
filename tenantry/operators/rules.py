"""Integrity rules. Each gives the rows that break it as (rule_id, entity_id, detail); an empty result is a pass."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.collation import collated_keys
from ..schema import TABLES
from . import hierarchy


def violations(df: DataFrame, rule_id: str, entity: str | Column, detail: str | Column) -> DataFrame:
    text = F.lit(detail) if isinstance(detail, str) else detail.cast("string")
    return df.select(F.lit(rule_id).alias("rule_id"), (F.col(entity) if isinstance(entity, str) else entity).cast("long").alias("entity_id"), text.alias("detail"))


def orphans(child: DataFrame, parent: DataFrame, column: str, parent_key: str = "id", entity: str = "id", rule_id: str = "exists") -> DataFrame:
    """Rows whose reference, if not null, names no parent."""
    bad = child.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_key).alias("__p")), F.col(column) == F.col("__p"), "left_anti")
    return violations(bad, rule_id, entity, F.concat_ws("=", F.lit(column), F.col(column)))


def duplicates(df: DataFrame, columns: list[str], entity: str = "id", rule_id: str = "unique") -> DataFrame:
    """The rows beyond the smallest entity of each repeated key; a key with a null column is never a duplicate.

    Texts are compared without regard to case, accents and trailing spaces.
    """
    known = collated_keys(df, columns).filter(functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    kept = known.groupBy(*columns).agg(F.min(entity).alias("__kept"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    return violations(known.join(kept, columns).filter(F.col(entity) > F.col("__kept")), rule_id, entity, F.concat_ws("|", *columns))


def outside_domain(df: DataFrame, column: str, values: tuple[str, ...], entity: str = "id", rule_id: str = "in") -> DataFrame:
    """Rows whose value, if not null, is none of the allowed ones."""
    return violations(df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values)), rule_id, entity, F.col(column))


def several_roots(organizations: DataFrame, rule_id: str = "single_root") -> DataFrame:
    """Root organizations beyond a tenant's first."""
    roots = organizations.filter("parent_id is null")
    first = roots.groupBy("tenant_id").agg(F.min("id").alias("__first"))
    return violations(roots.join(first, "tenant_id").filter(F.col("id") > F.col("__first")), rule_id, "id", F.concat(F.lit("tenant="), F.col("tenant_id")))


def own_parents(organizations: DataFrame, rule_id: str = "self_parent") -> DataFrame:
    return violations(organizations.filter("parent_id = id"), rule_id, "id", "parent is the row itself")


def cross_tenant(child: DataFrame, parent: DataFrame, column: str, entity: str = "id", rule_id: str = "same_tenant") -> DataFrame:
    """Rows that refer to a row of another tenant; both sides have tenant_id."""
    side = parent.select(F.col("id").alias("__p"), F.col("tenant_id").alias("__t"))
    bad = child.join(side, F.col(column) == F.col("__p")).filter(F.col("tenant_id") != F.col("__t"))
    return violations(bad, rule_id, entity, F.concat_ws("->", "tenant_id", "__t"))


def not_in_group(links: DataFrame, organizations: DataFrame, entities: DataFrame) -> DataFrame:
    """Links of companies to organizations that are no groups, of other entities than companies, or across tenants."""
    o = organizations.select(F.col("id").alias("organization_id"), F.col("type").alias("__ot"), F.col("tenant_id").alias("__o"))
    e = entities.select(F.col("id").alias("business_entity_id"), F.col("type").alias("__et"), F.col("tenant_id").alias("__e"))
    joined = links.join(o, "organization_id").join(e, "business_entity_id")
    why = F.when(~F.col("__ot").eqNullSafe("group"), "organization is no group").when(~F.col("__et").eqNullSafe("company"), "entity is no company").when(F.col("__o") != F.col("__e"), "other tenant")
    return violations(joined.filter(why.isNotNull()), "group_company", "id", why)


def temporary_contractor_links(links: DataFrame, contractors: DataFrame, entities: DataFrame) -> DataFrame:
    """Location links of contractor entities whose contractor is missing or temporary."""
    e = entities.filter("type = 'contractor'").select(F.col("id").alias("business_entity_id"))
    c = contractors.select("business_entity_id", "contractor_type")
    bad = links.join(e, "business_entity_id").join(c, "business_entity_id", "left").filter("contractor_type is null or contractor_type = 'temporary'")
    return violations(bad, "permanent_contractor", "id", F.coalesce("contractor_type", F.lit("missing")))


def regions_elsewhere(links: DataFrame, regions: DataFrame) -> DataFrame:
    """Location links whose operational region belongs to another location."""
    r = regions.select(F.col("id").alias("operational_region_id"), F.col("location_id").alias("__l"))
    return violations(links.join(r, "operational_region_id").filter(F.col("location_id") != F.col("__l")), "region_of_location", "id", F.concat_ws("->", "location_id", "__l"))


def foreign_brands(link_brands: DataFrame, links: DataFrame, entities: DataFrame, companies: DataFrame, company_brands: DataFrame) -> DataFrame:
    """Brands on a link of a contractor, or that the linked company does not carry."""
    link = links.select(F.col("id").alias("location_business_entity_id"), "business_entity_id")
    e = entities.select(F.col("id").alias("business_entity_id"), "type")
    carried = company_brands.join(companies.select(F.col("id").alias("company_id"), "business_entity_id"), "company_id").select("business_entity_id", "brand_id")
    rows = link_brands.join(link, "location_business_entity_id").join(e, "business_entity_id")
    bad = rows.filter("type <> 'company'").select("id", "brand_id").unionByName(rows.filter("type = 'company'").join(carried, ["business_entity_id", "brand_id"], "left_anti").select("id", "brand_id"))
    return violations(bad, "brand_of_company", "id", F.concat(F.lit("brand="), F.col("brand_id")))


def name_drift(companies: DataFrame, entities: DataFrame) -> DataFrame:
    """Companies whose own name differs from their entity's."""
    e = entities.select(F.col("id").alias("business_entity_id"), F.col("name").alias("__n"))
    return violations(companies.join(e, "business_entity_id").filter(~F.col("name").eqNullSafe(F.col("__n"))), "name_drift", "id", F.concat_ws(" <> ", "name", "__n"))


def check_state(state: dict[str, DataFrame]) -> DataFrame:
    """All declared rules (references, uniqueness, domains) and the hierarchy's over the tables of a state."""
    found = []
    for name, df in state.items():
        table, entity = TABLES[name], TABLES[name].key[0]
        found += [orphans(df, state[r.parent], r.column, r.parent_key, entity, f"{name}.{r.column}.exists") for r in table.references if r.parent in state]
        found += [duplicates(df, list(u), entity, f"{name}.{'_'.join(u)}.unique") for u in table.unique]
        found += [outside_domain(df, c, v, entity, f"{name}.{c}.in") for c, v in table.domains.items()]
    if "organizations" in state:
        found += [several_roots(state["organizations"]), own_parents(state["organizations"])]
    return functools.reduce(DataFrame.unionByName, found)


def check_rows(state: dict[str, DataFrame], changed: dict[str, DataFrame], roots: bool = True) -> DataFrame:
    """The declared rules for the changed rows of a state that holds them already; other rows are read only as parents or for equal keys.

    With ``roots`` a changed root organization must be its tenant's only one.
    """
    found = []
    for name, rows in changed.items():
        table, entity = TABLES[name], TABLES[name].key[0]
        found.append(violations(rows.filter(F.lit(False)), "", entity, ""))
        found += [orphans(rows, state[r.parent], r.column, r.parent_key, entity, f"{name}.{r.column}.exists") for r in table.references if r.parent in state]
        for u in table.unique:
            same = collated_keys(state[name], list(u)).join(collated_keys(rows.select(*u), list(u)).distinct(), list(u), "left_semi")
            found.append(duplicates(same, list(u), entity, f"{name}.{'_'.join(u)}.unique"))
        found += [outside_domain(rows, c, v, entity, f"{name}.{c}.in") for c, v in table.domains.items()]
    if "organizations" in changed:
        rows = changed["organizations"]
        found.append(own_parents(rows))
        if roots:
            tenants = rows.filter("parent_id is null").select("tenant_id").distinct()
            found.append(several_roots(state["organizations"].join(tenants, "tenant_id", "left_semi")))
    return functools.reduce(DataFrame.unionByName, found)


def endless_parents(organizations: DataFrame, rule_id: str = "no_cycle") -> DataFrame:
    """Organizations on or below a cycle of parents, at any depth: those without a topmost ancestor."""
    lost = hierarchy.resolve(organizations).filter("root is null").select("id")
    return violations(organizations.join(lost, "id", "left_semi"), rule_id, "id", F.concat(F.lit("parent="), F.col("parent_id")))


def several_brands(link_brands: DataFrame, links: DataFrame, rule_id: str = "one_brand") -> DataFrame:
    """Locations whose links name more than one brand, with the number of brands."""
    at = link_brands.join(links.select(F.col("id").alias("location_business_entity_id"), "location_id"), "location_business_entity_id")
    n = at.groupBy("location_id").agg(F.countDistinct("brand_id").alias("__n")).filter("__n > 1")
    return violations(n, rule_id, "location_id", F.concat(F.lit("brands="), F.col("__n")))
