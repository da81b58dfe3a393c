"""Registered queries over whole lifecycles: schema changes, discovered constraints, commits, layouts, ids, batches, dumps."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.collation import by_name, collated
from ..operators import hierarchy, relations, rules, sequences
from ..sources import dump, evolution, layout, metadata
from ..sources.store import StaleVersion, Store
from ..sources.workspace import new_dir
from . import batch, commands
from .mapping import SUPPLIER_BASE, Domain
from .queries import CTX, SQL, _rule, query

# schema changes


@functools.cache
def _versions() -> tuple[evolution.TableVersion, evolution.TableVersion]:
    """Links as they were first written, and what later changes make of them."""
    first = evolution.TableVersion.first("location_business_entities", "id long, location_id long, business_entity_id long, brand_id int, operational_unit_id int, nace_code string", {"nace_code": ("SUPPLY", "BUILDING")})
    renamed = first.rename("operational_unit_id", "operational_region_id").widen("operational_region_id", "long").drop("brand_id").add("hazard_class", "string")
    return first, renamed.allow("nace_code", "MACHINERY", "FURNITURE")


def _evolved_links(d: Domain) -> DataFrame:
    """Suppliers' links in files of the first version, customers' in files of the second, read under the second."""
    links, path = d.location_business_entities(), new_dir(d.spark)
    first, second = _versions()
    old = links.filter("nace_code = 'SUPPLY'").withColumn("brand_id", (F.col("business_entity_id") % 45).cast("int")).withColumnRenamed("operational_region_id", "operational_unit_id")
    evolution.write(old, first, path)
    evolution.write(links.filter("nace_code <> 'SUPPLY'").withColumn("hazard_class", F.lit("low")), second, path)
    return evolution.read(d.spark, second, path)


@query("SELECT id, location_id, business_entity_id, operational_region_id, nace_code, CASE WHEN nace_code <> 'SUPPLY' THEN 'low' END AS hazard_class FROM lbe", "lbe")
def schema_renamed_column(d: Domain) -> DataFrame:
    return _evolved_links(d)


@query("SELECT operational_region_id, count(*) AS n FROM lbe WHERE operational_region_id > 100 GROUP BY 1", "lbe")
def schema_filter_on_renamed(d: Domain) -> DataFrame:
    return _evolved_links(d).filter("operational_region_id > 100").groupBy("operational_region_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS id, c_mktsegment AS name, c_name AS segment, NULL::VARCHAR AS address FROM customer")
def schema_swapped_names(d: Domain) -> DataFrame:
    """Two columns change names, and a dropped one comes back empty, over files that keep the old names."""
    first = evolution.TableVersion.first("customers", "id long, name string, segment string, address string")
    path = new_dir(d.spark)
    evolution.write(d.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_mktsegment").alias("address")), first, path)
    second = first.rename("name", "old").rename("segment", "name").rename("old", "segment").drop("address").add("address", "string")
    return evolution.read(d.spark, second, path)


@_rule("in", "SELECT id AS entity_id, 'before ' || nace_code AS detail FROM lbe WHERE nace_code NOT IN ('SUPPLY', 'BUILDING') UNION ALL SELECT id, 'after ' || nace_code FROM lbe WHERE nace_code NOT IN ('SUPPLY', 'BUILDING', 'MACHINERY', 'FURNITURE')", "lbe")
def schema_widened_domain(d: Domain) -> DataFrame:
    """The values outside a domain before and after it was widened, in files of either version."""
    links = _evolved_links(d)
    found = [df.withColumn("detail", F.concat_ws(" ", F.lit(when), "detail")) for when, v in zip(("before", "after"), _versions(), strict=True) for df in evolution.outside_domains(links, v)]
    return functools.reduce(DataFrame.unionByName, found).withColumn("rule_id", F.lit("in"))


# constraints that nobody declared

# The columns of the test tables that can be keys or references, by family.
_COLUMNS = {
    "region": {"int": ["r_regionkey"], "text": ["r_name"]},
    "nation": {"int": ["n_nationkey", "n_regionkey"], "text": ["n_name"]},
    "customer": {"int": ["c_custkey", "c_nationkey"], "text": ["c_name", "c_mktsegment"]},
    "supplier": {"int": ["s_suppkey", "s_nationkey"], "text": ["s_name"]},
    "part": {"int": ["p_partkey", "p_size"], "text": ["p_name", "p_brand", "p_type"]},
    "orders": {"int": ["o_orderkey", "o_custkey"], "text": ["o_orderstatus", "o_orderpriority"]},
    "lineitem": {"int": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "text": ["l_returnflag", "l_linestatus"]},
}


def _constraint_sql() -> str:
    """Every key and every inclusion, each by an exact test."""
    keys = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS tab, '{c}' AS col, '{f}' AS family, count(*) > 0 AND count(*) = count(DISTINCT {c}) AS ok FROM {t}" for t, fs in _COLUMNS.items() for f, cs in fs.items() for c in cs) + ") WHERE ok"
    sides = [(t, c, f) for t, fs in _COLUMNS.items() for f, cs in fs.items() for c in cs]
    pairs = " UNION ALL ".join(
        f"SELECT '{t}' AS tab, '{c}' AS col, '{p}' AS parent, '{k}' AS parent_col, (SELECT count({c}) > 0 FROM {t}) AND NOT EXISTS (SELECT 1 FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {p} WHERE {k} IS NOT NULL)) AS ok"
        for t, c, f in sides
        for p, k, g in sides
        if f == g and t != p
    )
    bare = "substr({0}, strpos({0}, '_') + 1)"
    return f"""WITH k AS ({keys}), r AS (SELECT * FROM ({pairs}) WHERE ok)
      SELECT 'key' AS kind, tab, col, NULL AS parent, NULL AS parent_col, NULL AS rule FROM k
      UNION ALL SELECT 'reference', r.tab, r.col, parent, parent_col, CASE WHEN {bare.format("r.col")} = {bare.format("parent_col")} THEN 'named' ELSE 'values' END
      FROM r JOIN k ON k.tab = parent AND k.col = parent_col"""


@query(_constraint_sql())
def discovered_constraints(d: Domain) -> DataFrame:
    tables = {t: d.raw(t).select(*[c for cs in fs.values() for c in cs]) for t, fs in _COLUMNS.items()}
    return metadata.discover(tables)


# commits


@query("SELECT 'locations' AS part, id, CASE WHEN id = 1 THEN 'renamed' ELSE name END AS value FROM loc UNION ALL SELECT 'companies', id, 'corporate' FROM com UNION ALL SELECT 'stale', 3, 'refused' UNION ALL SELECT 'broken', 3, 'refused'", "loc", "com")
def committed_commands(d: Domain) -> DataFrame:
    """Three commits, one by a writer that is late and one with a violation, and what a reader then finds."""
    store = Store(d.spark, new_dir(d.spark))
    store.commit({}, d.state("tenants", "locations", "business_entities", "companies"), 0)
    state, at = store.state()
    renamed, found = commands.update_location(state, CTX, 1, {"name": "renamed"})
    store.commit(state, renamed, at, found)
    late, outcome = commands.update_location(state, CTX, 1, {"name": "late"})[0], "taken"
    try:
        store.commit(state, late, at)
    except StaleVersion:
        outcome = "refused"
    state, at = store.state()
    store.commit(state, commands.update_where(state, "companies", F.col("company_type") == "individual", {"company_type": "corporate"})[0], at)
    state, at = store.state()
    wrong, found = commands.update_location(state, CTX, 0, {"name": "other tenant"})
    refused = "refused" if store.commit(state, wrong, at, found) is None else "taken"
    state, at = store.state()
    said = d.spark.createDataFrame([("stale", at, outcome), ("broken", at, refused)], "part string, id long, value string")
    return said.unionByName(state["locations"].select(F.lit("locations").alias("part"), "id", F.col("name").alias("value"))).unionByName(state["companies"].select(F.lit("companies").alias("part"), "id", F.col("company_type").alias("value")))


# tenants' folders


def _laid_out(d: Domain) -> str:
    path = new_dir(d.spark)
    layout.write(d.state("business_entities")["business_entities"], path)
    return path


@query("SELECT id, tenant_id, CASE WHEN tenant_id = 1 AND type = 'contractor' THEN 'changed' ELSE name END AS name FROM ent", "ent")
def tenant_bulk_update(d: Domain) -> DataFrame:
    path = _laid_out(d)
    layout.update_where(d.spark, path, "business_entities", F.col("type") == "contractor", {"name": "changed", "tenant_id": 2}, CTX)
    return layout.scan(d.spark, path, "business_entities").select("id", "tenant_id", "name")


@query("SELECT id, tenant_id FROM ent WHERE tenant_id <> 3 AND NOT (tenant_id = 1 AND type = 'company')", "ent")
def tenant_bulk_delete(d: Domain) -> DataFrame:
    """All rows of one tenant, whose folder then goes, and some of another."""
    path = _laid_out(d)
    layout.delete_where(d.spark, path, "business_entities", F.col("tenant_id") == 3)
    layout.delete_where(d.spark, path, "business_entities", F.col("type") == "company", CTX)
    return layout.scan(d.spark, path, "business_entities").select("id", "tenant_id")


@query("SELECT id, name FROM ent WHERE tenant_id = 1", "ent")
def tenant_pruned_scan(d: Domain) -> DataFrame:
    return layout.scan(d.spark, _laid_out(d), "business_entities", CTX).select("id", "name")


# generated ids


@query("SELECT id, organization_id, business_entity_id FROM oc UNION ALL SELECT (SELECT max(id) FROM oc) + row_number() OVER (ORDER BY organization_id, business_entity_id, source), organization_id, business_entity_id FROM (SELECT n_regionkey + 1000 AS organization_id, c_custkey AS business_entity_id, 'customer' AS source FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT o_orderkey % 25, o_custkey, 'order' FROM orders)", "oc")
def bulk_insert_ids(d: Domain) -> DataFrame:
    """Links without ids, each company to its holding and each order's once more, get ids above the largest."""
    home = d.business_entities().filter("type = 'company'").select((F.col("tenant_id") + 1000).alias("organization_id"), F.col("id").alias("business_entity_id"))
    again = d.organization_companies().select("organization_id", "business_entity_id")
    rows = home.withColumn("source", F.lit("customer")).unionByName(again.withColumn("source", F.lit("order")))
    return sequences.insert(d.organization_companies(), rows, ["organization_id", "business_entity_id", "source"]).select("id", "organization_id", "business_entity_id")


@query("SELECT id, name FROM bra UNION ALL SELECT (SELECT max(id) FROM bra) + row_number() OVER (ORDER BY name), name FROM (SELECT DISTINCT p_type AS name FROM part WHERE p_type NOT IN (SELECT name FROM bra))", "bra")
def first_or_create_ids(d: Domain) -> DataFrame:
    wanted = d.raw("part").select(F.col("p_type").alias("name")).unionByName(d.brands().select("name"))
    return sequences.first_or_create(d.brands().select("id", "name"), wanted, ["name"])


# batches

_REQUESTS = """req AS (SELECT o_orderkey AS request, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE n_regionkey + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END END AS tenant_id,
  CASE WHEN o_orderkey % 17 = 0 THEN -o_custkey ELSE o_custkey END AS id, o_orderkey % 2 = 0 AS has_name, CASE WHEN o_orderkey % 14 <> 0 THEN o_orderpriority END AS name,
  o_orderkey % 3 = 0 AS has_type, CASE WHEN o_orderkey % 9 = 0 THEN 'broken' ELSE 'contractor' END AS type FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
 seen AS (SELECT req.*, ent.id IS NULL AS lost, ent.id IS NOT NULL AND req.tenant_id IS NOT NULL AND req.tenant_id <> ent.tenant_id AS foreign_, has_type AND req.type = 'broken' AS odd FROM req LEFT JOIN ent ON ent.id = req.id),
 good AS (SELECT * FROM seen WHERE NOT (lost OR foreign_ OR odd)),
 fold AS (SELECT id, max({'r': request, 'v': name}) FILTER (WHERE has_name) AS n, max({'r': request, 'v': type}) FILTER (WHERE has_type) AS t FROM good GROUP BY id)"""


@query("SELECT 'entity' AS part, ent.id, CASE WHEN n IS NULL THEN name ELSE n.v END AS name, CASE WHEN t IS NULL THEN type ELSE t.v END AS type FROM ent LEFT JOIN fold ON fold.id = ent.id UNION ALL SELECT 'broken', request, 'business_entities.id.exists', id::VARCHAR FROM seen WHERE lost UNION ALL SELECT 'broken', request, 'business_entities.tenant', tenant_id::VARCHAR FROM seen WHERE foreign_ UNION ALL SELECT 'broken', request, 'business_entities.type.in', 'broken' FROM seen WHERE odd", "ent")
def patch_batch(d: Domain) -> DataFrame:
    """A patch for each order: names and types of customers, some of them null, of unknown rows, other tenants or no type."""
    entities = d.business_entities().select(F.col("id").alias("o_custkey"), F.col("tenant_id").alias("t")).filter(F.col("o_custkey") < SUPPLIER_BASE)
    o = d.raw("orders").join(entities, "o_custkey")
    key = F.col("o_orderkey")
    name, kind = F.when(key % 14 != 0, F.col("o_orderpriority")), F.when(key % 9 == 0, "broken").otherwise("contractor")
    none = F.lit(None).cast("map<string,string>")
    changes = F.map_concat(*[F.coalesce(m, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))) for m in (F.when(key % 2 == 0, F.create_map(F.lit("name"), name)).otherwise(none), F.when(key % 3 == 0, F.create_map(F.lit("type"), kind)).otherwise(none))])
    tenant = F.when(key % 11 != 0, F.col("t") + F.when(key % 13 == 0, 1).otherwise(0))
    requests = o.select(key.alias("request"), tenant.alias("tenant_id"), F.when(key % 17 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("id"), changes.alias("changes"))
    new, found = batch.patch(d.state("tenants", "business_entities"), "business_entities", requests)
    rows = new["business_entities"].select(F.lit("entity").alias("part"), "id", "name", "type")
    return rows.unionByName(found.select(F.lit("broken").alias("part"), F.col("request").alias("id"), F.col("rule_id").alias("name"), F.col("detail").alias("type")))


SQL["patch_batch"] = SQL["patch_batch"].replace(" SELECT 'entity'", f", {_REQUESTS} SELECT 'entity'", 1)


# names as users see them

_MIXED = "CASE id % 3 WHEN 0 THEN upper(name) WHEN 1 THEN replace(name, 'e', 'é') || ' ' ELSE lower(name) END"


def _mixed(df: DataFrame) -> DataFrame:
    """Names in mixed case, with accents and trailing spaces."""
    return df.withColumn("name", F.when(F.col("id") % 3 == 0, F.upper("name")).when(F.col("id") % 3 == 1, F.concat(F.replace("name", F.lit("e"), F.lit("é")), F.lit(" "))).otherwise(F.lower("name")))


@query(f"SELECT id, name, row_number() OVER (PARTITION BY tenant_id ORDER BY strip_accents(lower(rtrim(name))), id) AS place FROM (SELECT id, tenant_id, {_MIXED} AS name FROM ent)", "ent")
def collated_places(d: Domain) -> DataFrame:
    """Each entity's place in its tenant's list."""
    place = F.row_number().over(Window.partitionBy("tenant_id").orderBy(collated(F.col("name")), "id"))
    return _mixed(d.business_entities()).select("id", "name", place.cast("long").alias("place"))


@query(f"SELECT id, name FROM (SELECT id, {_MIXED} AS name FROM loc) ORDER BY strip_accents(lower(rtrim(name))), id", "loc")
def collated_list(d: Domain) -> DataFrame:
    return by_name(_mixed(d.locations())).select("id", "name")


@_rule("unique", f"SELECT id AS entity_id, detail FROM (SELECT id, name AS detail, min(id) OVER (PARTITION BY strip_accents(lower(rtrim(name)))) AS f FROM (SELECT id, {_MIXED} AS name FROM (SELECT p_partkey AS id, p_brand || 'e' AS name FROM part))) WHERE id > f")
def collated_duplicates(d: Domain) -> DataFrame:
    parts = d.raw("part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("e")).alias("name"))
    return rules.duplicates(_mixed(parts), ["name"])


# hierarchies


@query("SELECT o_orderkey AS id, first_value(o_orderkey) OVER w AS root, row_number() OVER w - 1 AS depth FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def hierarchy_depths(d: Domain) -> DataFrame:
    """Each order below its customer's order before it: the first one and the steps to it."""
    chains = d.raw("orders").select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("parent_id"))
    return hierarchy.resolve(chains)


# dumps


@query("SELECT id, tenant_id, type, name FROM (SELECT id, tenant_id, type, 'it''s; \\ ' || name || chr(10) || '(a),' AS name FROM ent)", "ent")
def dump_restored(d: Domain) -> DataFrame:
    """All entities, with names that hold the dump's own signs, written as a dump and read back."""
    path = new_dir(d.spark)
    odd = d.business_entities().withColumn("name", F.concat(F.lit("it's; \\ "), "name", F.lit("\n(a),")))
    dump.write_dump(odd, path, "business_entities")
    return dump.read_dump(d.spark, path, "business_entities").select("id", "tenant_id", "type", "name")


# further relations


@query("SELECT user_id::BIGINT AS id, 'user-' || user_id AS name, 'user-' || user_id || '@example.com' AS email, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS roles FROM events GROUP BY user_id")
def user_view(d: Domain) -> DataFrame:
    """Users as an API shows them: id, name, e-mail and role names."""
    roles = d.user_roles().select(F.col("model_id").cast("long").alias("user_id"), "role")
    users = d.users().withColumn("email", F.concat("name", F.lit("@example.com")))
    return relations.nested_children(users, roles, "user_id", ["role"], "roles").select("id", "name", "email", F.array_join("roles.role", ",").alias("roles"))


@query("SELECT com.id, org.id AS group_id, org.name AS group_name, oc.id AS link_id FROM com JOIN oc ON oc.business_entity_id = com.business_entity_id JOIN org ON org.id = oc.organization_id", "com", "oc", "org")
def company_groups(d: Domain) -> DataFrame:
    """Companies' groups, linked by the entity and not by the company's own id."""
    out = relations.through(d.companies(), d.organization_companies(), d.organizations(), ("business_entity_id", "business_entity_id"), ("organization_id", "id"), ["id"])
    return out.select("id", F.col("related_id").alias("group_id"), F.col("related_name").alias("group_name"), F.col("pivot.id").alias("link_id"))


@query("SELECT lbe.id, string_agg(b.name, ',' ORDER BY b.name) AS brands FROM lbe JOIN (SELECT id AS link, 11 + (business_entity_id + i * 7) % 45 AS brand_id FROM lbe, (SELECT unnest([1, 2]) AS i)) lb ON lb.link = lbe.id JOIN bra b ON b.id = lb.brand_id GROUP BY lbe.id UNION ALL SELECT id, '' FROM lbe WHERE NOT EXISTS (SELECT 1 FROM bra WHERE bra.id IN (11 + (business_entity_id + 7) % 45, 11 + (business_entity_id + 14) % 45))", "lbe", "bra")
def link_own_brands(d: Domain) -> DataFrame:
    """The brands of a link itself, which are not its company's."""
    links = d.location_business_entities()
    two = links.select(F.col("id").alias("location_business_entity_id"), "business_entity_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("i"))
    own = two.select("location_business_entity_id", (11 + (F.col("business_entity_id") + F.col("i") * 7) % 45).alias("brand_id"))
    named = relations.belongs_to(own, d.brands(), "brand_id", "b").filter("b is not null").select("location_business_entity_id", F.col("b.name").alias("brand"))
    return relations.nested_children(links, named, "location_business_entity_id", ["brand"], "brands").select("id", F.array_join("brands.brand", ",").alias("brands"))


@query("SELECT id, name FROM com WHERE NOT EXISTS (SELECT 1 FROM cb WHERE cb.company_id = com.id AND cb.brand_id = 11)", "com", "cb")
def companies_without_brand(d: Domain) -> DataFrame:
    return relations.doesnt_have(d.companies(), d.company_brands().filter("brand_id = 11"), "id", "company_id").select("id", "name")


@query("SELECT id, name FROM reg WHERE location_id = 3 ORDER BY name LIMIT 1", "reg")
def first_region_or_fail(d: Domain) -> DataFrame:
    return relations.first_or_fail(d.operational_regions().filter("location_id = 3"), "name").select("id", "name")
