"""State changes as pure functions: (state, command) to (new state, violations).

A state is a dict of domain tables. A command that breaks a rule leaves the caller with the old state: commit()
writes a new snapshot only if the violations are empty. Rules are checked on the rows that a command adds or changes,
so an old fault elsewhere blocks no command. Ids are given by the caller, as rows have no sequences.
"""

from __future__ import annotations

import functools
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import TenantContext, require
from ..functions import columns
from ..operators import reconcile, referential, rules
from ..schema import TABLES
from ..sources.tables import snapshot
from ..sources.workspace import exists, hadoop_path
from ..sources.workspace import remove as remove_path

State = dict[str, DataFrame]
Result = tuple[State, DataFrame]


def row(state: State, name: str, /, *rows: dict, **values) -> DataFrame:
    """Rows of a table, or one row of the given values; columns that are not given are null."""
    spark = next(iter(state.values())).sparkSession
    struct = TABLES[name].struct
    return spark.createDataFrame([tuple(r.get(f.name) for f in struct) for r in rows or (values,)], struct)


def _created(state: State, name: str, /, *rows: dict, **values) -> DataFrame:
    """row() with both timestamps, unless they are given."""
    at = datetime.now(UTC)
    return row(state, name, *[{"created_at": at, "updated_at": at, **r} for r in rows or (values,)])


def _patched(df: DataFrame, which: Column, changes: dict) -> DataFrame:
    """df with the changes, and a new updated_at, in the rows for which ``which`` holds."""
    if "updated_at" in df.columns:
        changes = {"updated_at": datetime.now(UTC), **changes}
    return df.withColumns({c: F.when(which, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()})


def _checked(new: State, changed: State, *found: DataFrame, roots: bool = True) -> Result:
    """The violations of the changed rows: declared rules and those of the command."""
    return new, functools.reduce(DataFrame.unionByName, found, rules.check_rows(new, changed, roots))


def _added(state: State, added: State, *found: DataFrame) -> Result:
    """The state with rows added to its tables."""
    return _checked(state | {n: state[n].unionByName(rows) for n, rows in added.items()}, added, *found)


def _absent(df: DataFrame, ids: list[int], rule: str, detail: str) -> DataFrame:
    """A violation for each id that is no row of df."""
    asked = df.sparkSession.createDataFrame([(i,) for i in ids], "asked long")
    return rules.violations(asked.join(df.select(F.col("id").alias("asked")), "asked", "left_anti"), rule, "asked", detail)


def _own(df: DataFrame, ctx: TenantContext, ids: list[int], rule: str) -> DataFrame:
    """A violation for each id that is no row of the tenant."""
    return _absent(df.filter(F.col("tenant_id") == ctx.tenant_id), ids, rule, "not in tenant")


def insert(state: State, name: str, /, **values) -> Result:
    """A row of any table under its declared rules: tenants, brands, regions and the like."""
    return _added(state, {name: _created(state, name, **values)})


def update_where(state: State, name: str, condition: Column, changes: dict, *found: DataFrame) -> Result:
    """Patch all rows for which the condition holds; values may be columns. Ids stay."""
    marked = state[name].withColumn("__hit", F.coalesce(condition, F.lit(False)))
    new = _patched(marked, F.col("__hit"), {c: v for c, v in changes.items() if c != "id"})
    return _checked(state | {name: new.drop("__hit")}, {name: new.filter("__hit").drop("__hit")}, *found, roots="parent_id" in changes)


def delete_where(state: State, name: str, condition: Column) -> Result:
    """Delete all rows for which the condition holds, with the declared referential actions."""
    return referential.delete(state, name, state[name].filter(condition))


def update(state: State, name: str, key: int, changes: dict, ctx: TenantContext | None = None) -> Result:
    """Patch one row. tenant_id cannot change; with a context the row must be the tenant's."""
    kept = {c: v for c, v in changes.items() if c != "tenant_id"}
    return update_where(state, name, F.col("id") == key, kept, *([_own(state[name], ctx, [key], f"{name}.tenant")] if ctx else []))


def remove(state: State, name: str, key: int, ctx: TenantContext | None = None) -> Result:
    """Delete one row with the declared referential actions."""
    new, found = delete_where(state, name, F.col("id") == key)
    return new, found.unionByName(_own(state[name], ctx, [key], f"{name}.tenant")) if ctx else found


def create_tenant(state: State, **values) -> Result:
    """A tenant, active unless told otherwise, whose slug has letters, digits, dashes and underscores only and is taken by none."""
    new, found = insert(state, "tenants", **{"status": True, **values})
    return new, found.unionByName(_odd_slugs(new["tenants"].filter(F.col("id") == values["id"])))


def update_tenant(state: State, key: int, changes: dict) -> Result:
    """Patch a tenant; its own slug is no taken one. The files of replaced_logos() may go once the new state is committed."""
    new, found = update(state, "tenants", key, changes)
    return new, found.unionByName(_odd_slugs(new["tenants"].filter(F.col("id") == key))).unionByName(_absent(state["tenants"], [key], "tenants.id.exists", "no row"))


def delete_tenant(state: State, key: int) -> Result:
    """A tenant and all that is its own; companies keep their entities, and so keep the tenant."""
    return remove(state, "tenants", key)


def _odd_slugs(rows: DataFrame) -> DataFrame:
    return rules.violations(rows.filter(~columns.alpha_dash(F.col("slug"))), "tenants.slug.alpha_dash", "id", F.col("slug"))


def replaced_logos(old: State, new: State) -> DataFrame:
    """(id, logo_path): stored logos that the old state names and the new one does not."""
    return old["tenants"].filter("logo_path is not null").select("id", "logo_path").join(new["tenants"].select("logo_path").distinct(), "logo_path", "left_anti").select("id", "logo_path")


def create_organization(state: State, ctx: TenantContext | None, **values) -> Result:
    """An organization of the tenant: a root only if there is none, else below one of the tenant's own."""
    ctx = require(ctx)
    parent = values.get("parent_id")
    found = [_own(state["organizations"], ctx, [parent], "parent_in_tenant")] if parent is not None else []
    return _added(state, {"organizations": _created(state, "organizations", **{**values, "tenant_id": ctx.tenant_id})}, *found)


def update_organization(state: State, ctx: TenantContext | None, key: int, changes: dict) -> Result:
    """An absent parent_id keeps the parent; a null one makes a root; the row itself is no parent."""
    ctx = require(ctx)
    new, found = update(state, "organizations", key, changes, ctx)
    parent = changes.get("parent_id")
    return new, found.unionByName(_own(state["organizations"], ctx, [parent], "parent_in_tenant")) if parent is not None else found


def create_company(state: State, ctx: TenantContext | None, entity_id: int, company_id: int, name: str, company_type: str) -> Result:
    """An entity of type company and its company row, with one name."""
    ctx = require(ctx)
    return _added(state, {
        "business_entities": _created(state, "business_entities", id=entity_id, tenant_id=ctx.tenant_id, type="company", name=name),
        "companies": _created(state, "companies", id=company_id, business_entity_id=entity_id, name=name, company_type=company_type),
    })


def _rename_entity(state: State, owners: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """All entities, those of the owners' business_entity_id renamed, and the renamed ones alone."""
    own = owners.select(F.col("business_entity_id").alias("__e")).distinct()
    joined = state["business_entities"].join(own, F.col("id") == F.col("__e"), "left")
    new = _patched(joined, F.col("__e").isNotNull(), {"name": name})
    return new.drop("__e"), new.filter("__e is not null").drop("__e")


def update_company(state: State, company_id: int, company_type: str | None = None, name: str | None = None) -> Result:
    """company_type changes on the company, the name on its entity only."""
    new, changed = dict(state), {}
    which = F.col("id") == company_id
    if company_type is not None:
        new["companies"] = _patched(state["companies"], which, {"company_type": company_type})
        changed["companies"] = new["companies"].filter(which)
    if name is not None:
        new["business_entities"], changed["business_entities"] = _rename_entity(state, state["companies"].filter(which), name)
    return _checked(new, changed or {"companies": state["companies"].filter(F.lit(False))})


def _delete_with_entity(state: State, ctx: TenantContext | None, name: str, key: int) -> Result:
    """A company or contractor, then its entity if it is the tenant's; another tenant's entity stays as an orphan."""
    own = state[name].filter(F.col("id") == key).select(F.col("business_entity_id").alias("id"))
    first, found = remove(state, name, key)
    entities = state["business_entities"].join(own, "id", "left_semi")
    second, more = referential.delete(first, "business_entities", entities if ctx is None else entities.filter(F.col("tenant_id") == ctx.tenant_id))
    return second, found.unionByName(more)


def delete_company(state: State, ctx: TenantContext | None, company_id: int) -> Result:
    return _delete_with_entity(state, ctx, "companies", company_id)


def create_contractor(state: State, ctx: TenantContext | None, entity_id: int, contractor_id: int, name: str, contractor_type: str) -> Result:
    ctx = require(ctx)
    return _added(state, {
        "business_entities": _created(state, "business_entities", id=entity_id, tenant_id=ctx.tenant_id, type="contractor", name=name),
        "contractors": _created(state, "contractors", id=contractor_id, business_entity_id=entity_id, contractor_type=contractor_type),
    })


def update_contractor(state: State, contractor_id: int, name: str, contractor_type: str) -> Result:
    """contractor_type changes on the contractor, the name on its entity, which must be there and of type contractor."""
    which = F.col("id") == contractor_id
    own = state["contractors"].filter(which)
    fit = state["business_entities"].filter("type = 'contractor'").select(F.col("id").alias("business_entity_id"))
    unfit = rules.violations(own.join(fit, "business_entity_id", "left_anti"), "contractor_entity", "id", "entity is missing or no contractor")
    contractors = _patched(state["contractors"], which, {"contractor_type": contractor_type})
    entities, renamed = _rename_entity(state, own, name)
    return _checked(state | {"contractors": contractors, "business_entities": entities}, {"contractors": contractors.filter(which), "business_entities": renamed}, unfit)


def delete_contractor(state: State, ctx: TenantContext | None, contractor_id: int) -> Result:
    return _delete_with_entity(state, ctx, "contractors", contractor_id)


def create_location(state: State, ctx: TenantContext | None, **values) -> Result:
    """A location of the tenant, whatever tenant_id is given."""
    return insert(state, "locations", **{**values, "tenant_id": require(ctx).tenant_id})


def update_location(state: State, ctx: TenantContext | None, key: int, changes: dict) -> Result:
    return update(state, "locations", key, changes, require(ctx))


def delete_location(state: State, ctx: TenantContext | None, key: int) -> Result:
    return remove(state, "locations", key, require(ctx))


def create_region(state: State, location_id: int, **values) -> Result:
    """An operational region with its location's tenant; active unless told otherwise."""
    place = state["locations"].select(F.col("id").alias("location_id"), "tenant_id")
    new = _created(state, "operational_regions", **{"is_active": True, **values, "location_id": location_id}).drop("tenant_id").join(place, "location_id", "left")
    return _added(state, {"operational_regions": new.select(*state["operational_regions"].columns)})


def _region_at(state: State, ctx: TenantContext, location_id: int, key: int) -> list[DataFrame]:
    """Violations if the location is not the tenant's or the region not the location's."""
    here = state["operational_regions"].filter(F.col("location_id") == location_id)
    return [_own(state["locations"], ctx, [location_id], "locations.tenant"), _absent(here, [key], "region_of_location", "region of another location")]


def update_region(state: State, ctx: TenantContext | None, location_id: int, key: int, changes: dict) -> Result:
    """Patch a region of the tenant's location; location and tenant stay."""
    kept = {c: v for c, v in changes.items() if c not in ("tenant_id", "location_id")}
    return update_where(state, "operational_regions", F.col("id") == key, kept, *_region_at(state, require(ctx), location_id, key))


def delete_region(state: State, ctx: TenantContext | None, location_id: int, key: int) -> Result:
    new, found = remove(state, "operational_regions", key)
    return new, functools.reduce(DataFrame.unionByName, _region_at(state, require(ctx), location_id, key), found)


def create_brand(state: State, ctx: TenantContext | None, company_ids: list[int] | None = None, **values) -> Result:
    """A brand of the tenant and the companies that carry it, which must be the tenant's."""
    ctx = require(ctx)
    first, found = insert(state, "brands", **{**values, "tenant_id": ctx.tenant_id})
    new, more = set_company_brands(first, ctx, values["id"], company_ids)
    return new, found.unionByName(more)


def set_company_brands(state: State, ctx: TenantContext | None, brand_id: int, company_ids: list[int] | None) -> Result:
    """The companies that carry a brand; None leaves them untouched. All must be the tenant's."""
    ctx = require(ctx)
    if company_ids is None:
        return state, rules.violations(state["brands"].limit(0), "", "id", "")
    spark = state["brands"].sparkSession
    wanted = spark.createDataFrame([(c, brand_id) for c in dict.fromkeys(company_ids)], "company_id long, brand_id long")
    owner = spark.createDataFrame([(brand_id,)], "brand_id long")
    new = reconcile.sync(state["company_brands"], wanted, "brand_id", "company_id", owner).select(*state["company_brands"].columns)
    tenants = state["companies"].join(state["business_entities"].select(F.col("id").alias("business_entity_id"), "tenant_id"), "business_entity_id").select("id", "tenant_id")
    return _checked(state | {"company_brands": new}, {"company_brands": wanted}, _own(tenants, ctx, list(company_ids), "company_in_tenant"))


def set_group_companies(state: State, organization_id: int, links: DataFrame) -> Result:
    """The companies of a group, from (id, business_entity_id); none may be in another group."""
    wanted = links.withColumn("organization_id", F.lit(organization_id).cast("long"))
    owner = wanted.sparkSession.createDataFrame([(organization_id,)], "organization_id long")
    old = state["organization_companies"]
    kept = old.join(owner, "organization_id", "left_anti").unionByName(old.join(wanted, ["organization_id", "business_entity_id"], "left_semi"))
    new = kept.unionByName(wanted.join(old, ["organization_id", "business_entity_id"], "left_anti"), allowMissingColumns=True).select(*old.columns)
    own = new.filter(F.col("organization_id") == organization_id)
    return _checked(state | {"organization_companies": new}, {"organization_companies": own}, rules.not_in_group(own, state["organizations"], state["business_entities"]))


def attach_group_company(state: State, link_id: int, organization_id: int, entity_id: int) -> Result:
    """One company more in a group; nothing changes if it is there already. It may be in no other group."""
    link = _created(state, "organization_companies", id=link_id, organization_id=organization_id, business_entity_id=entity_id)
    new = reconcile.attach_if_absent(state["organization_companies"], link, ["organization_id", "business_entity_id"])
    return _checked(state | {"organization_companies": new}, {"organization_companies": link}, rules.not_in_group(link, state["organizations"], state["business_entities"]))


def detach_group_company(state: State, organization_id: int, entity_id: int) -> Result:
    """One company less in a group; both must be what they are called, of one tenant."""
    link = row(state, "organization_companies", organization_id=organization_id, business_entity_id=entity_id)
    new = reconcile.detach(state["organization_companies"], link, ["organization_id", "business_entity_id"])
    return state | {"organization_companies": new}, rules.not_in_group(link, state["organizations"], state["business_entities"])


def _link_rules(state: State, links: DataFrame) -> list[DataFrame]:
    return [rules.temporary_contractor_links(links, state["contractors"], state["business_entities"]), rules.regions_elsewhere(links, state["operational_regions"])]


def link_entity(state: State, brand_links: list[tuple[int, int]] | None = None, **values) -> Result:
    """A business entity at a location, with brands (id of the link row, brand) if it is a company."""
    link = _created(state, "location_business_entities", **values)
    added, found = {"location_business_entities": link}, _link_rules(state, link)
    if brand_links:
        own = _created(state, "location_business_entity_brands", *[{"id": i, "location_business_entity_id": values["id"], "brand_id": b} for i, b in brand_links])
        added["location_business_entity_brands"] = own
        found.append(rules.foreign_brands(own, link, state["business_entities"], state["companies"], state["company_brands"]))
    return _added(state, added, *found)


def update_link(state: State, location_id: int, entity_id: int, changes: dict, brand_links: list[tuple[int, int]] | None = None) -> Result:
    """Patch all links of an entity with a location; brands that are given replace those of the first of these links."""
    which = (F.col("location_id") == location_id) & (F.col("business_entity_id") == entity_id)
    links = _patched(state["location_business_entities"], which, {c: v for c, v in changes.items() if c not in ("id", "location_id", "business_entity_id")})
    rows = links.filter(which)
    new, changed = state | {"location_business_entities": links}, {"location_business_entities": rows}
    found = _link_rules(state, rows)
    if brand_links is not None:
        first = rows.groupBy("location_id", "business_entity_id").agg(F.min("id").alias("location_business_entity_id"))
        wanted = _created(state, "location_business_entity_brands", *[{"id": i, "brand_id": b} for b, i in {b: i for i, b in brand_links}.items()]) if brand_links else state["location_business_entity_brands"].limit(0)
        at = wanted.drop("location_business_entity_id").withColumns({"location_id": F.lit(location_id).cast("long"), "business_entity_id": F.lit(entity_id).cast("long")})
        own = at.join(first, ["location_id", "business_entity_id"]).select(*wanted.columns)
        kept = state["location_business_entity_brands"].join(first.select("location_business_entity_id"), "location_business_entity_id", "left_anti")
        new["location_business_entity_brands"] = kept.select(*wanted.columns).unionByName(own)
        changed["location_business_entity_brands"] = own
        found.append(_absent(rows.select(F.col("business_entity_id").alias("id")), [entity_id], "link_exists", "entity is not at the location"))
        found.append(rules.foreign_brands(own, rows, state["business_entities"], state["companies"], state["company_brands"]))
    return _checked(new, changed, *found)


def unlink_entity(state: State, location_id: int, entity_id: int) -> Result:
    """Remove all links of an entity with a location, and their brands."""
    return delete_where(state, "location_business_entities", (F.col("location_id") == location_id) & (F.col("business_entity_id") == entity_id))


def onboard(state: State, kind: str, ids: dict[str, int], tenant: dict, organization: dict, company: dict | None = None, location: dict | None = None) -> Result:
    """A tenant, its root organization and, by kind (holding, group, company), a first company and location.

    For kind company the organization has no type, so its company link breaks the rule that only groups have
    companies: reported as a violation, as the rule stands.
    """
    ctx, found = TenantContext(ids["tenant"]), []
    steps = [lambda s: insert(s, "tenants", id=ids["tenant"], **{"status": True, **tenant})]
    steps.append(lambda s: create_organization(s, ctx, id=ids["organization"], type=kind if kind in ("holding", "group") else None, **organization))
    if company:
        steps.append(lambda s: create_company(s, ctx, ids["entity"], ids["company"], company["name"], company["company_type"]))
        if kind != "holding":
            link = row(state, "organization_companies", id=ids["link"], business_entity_id=ids["entity"]).select("id", "business_entity_id")
            steps.append(lambda s: set_group_companies(s, ids["organization"], link))
    if location:
        steps.append(lambda s: insert(s, "locations", id=ids["location"], tenant_id=ids["tenant"], **location))
    for step in steps:
        state, broken = step(state)
        found.append(broken)
    return state, functools.reduce(DataFrame.unionByName, found)


def commit(result: Result, root: str) -> bool:
    """Write the new state as a snapshot at root if no rule is broken; root must not exist.

    The tables are written beside root and moved there by one rename, so a failing write leaves nothing at root. To
    commit one state after another use sources.store.Store.
    """
    state, found = result
    if not found.isEmpty():
        return False
    spark = found.sparkSession
    if exists(spark, root):
        raise FileExistsError(root)
    draft = f"{root.rstrip('/')}.{uuid.uuid4().hex}"
    try:
        snapshot(state, draft)
        source, fs = hadoop_path(spark, draft)
        if not fs.rename(source, hadoop_path(spark, root)[0]):
            raise OSError(f"{root} could not be made")
    except BaseException:
        remove_path(spark, draft)
        raise
    return True
