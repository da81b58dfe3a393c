"""The registered queries over the mapped domain tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import TenantContext, scope
from ..functions import columns as C
from ..operators import reconcile, referential, relations, rules
from ..sources.tables import visible
from . import commands
from .mapping import SUPPLIER_BASE, Domain

CTX = TenantContext(1)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The mapped tables in SQL, as common table expressions that a query names after WITH.
_CTE = {
    "loc": "loc AS (SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS tenant_id, n_name AS name FROM nation)",
    "org": "org AS (SELECT (r_regionkey + 1000)::BIGINT AS id, r_regionkey::BIGINT AS tenant_id, NULL::BIGINT AS parent_id, r_name AS name, 'holding' AS type FROM region UNION ALL SELECT n_nationkey::BIGINT, n_regionkey::BIGINT, (n_regionkey + 1000)::BIGINT, n_name, 'group' FROM nation)",
    "ent": f"ent AS (SELECT c_custkey AS id, n_regionkey::BIGINT AS tenant_id, 'company' AS type, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT s_suppkey + {SUPPLIER_BASE}, n_regionkey::BIGINT, 'contractor', s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)",
    "con": f"con AS (SELECT s_suppkey AS id, s_suppkey + {SUPPLIER_BASE} AS business_entity_id, CASE WHEN s_acctbal < 0 THEN 'temporary' ELSE 'permanent' END AS contractor_type FROM supplier)",
    "com": "com AS (SELECT c_custkey AS id, c_custkey AS business_entity_id, c_name AS name, CASE WHEN c_acctbal < 0 THEN 'individual' ELSE 'corporate' END AS company_type FROM customer)",
    "bra": "bra AS (SELECT DISTINCT regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS id, regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT % 5 AS tenant_id, p_brand AS name FROM part)",
    "cb": "cb AS (SELECT DISTINCT o_custkey AS company_id, regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS brand_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)",
    "oc": "oc AS (SELECT o_orderkey AS id, o_orderkey % 25 AS organization_id, o_custkey AS business_entity_id FROM orders)",
    "lbe": f"lbe AS (SELECT business_entity_id * 100 + location_id AS id, location_id, business_entity_id, CASE WHEN business_entity_id % 3 <> 0 THEN location_id * 10 + business_entity_id % 5 END AS operational_region_id, nace_code FROM (SELECT c_nationkey::BIGINT AS location_id, c_custkey AS business_entity_id, c_mktsegment AS nace_code FROM customer UNION ALL SELECT DISTINCT c_nationkey::BIGINT, l_suppkey + {SUPPLIER_BASE}, 'SUPPLY' FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey))",
    "reg": "reg AS (SELECT n_nationkey::BIGINT * 10 + i AS id, n_regionkey::BIGINT AS tenant_id, n_nationkey::BIGINT + CASE WHEN i = 4 THEN 1 ELSE 0 END AS location_id, 'region-' || n_nationkey || '-' || i AS name FROM nation, (SELECT unnest(range(5)) AS i))",
}


def query(sql: str, *tables: str):
    """Register a function of a Domain under its name, with its SQL over the named mapped tables."""

    def keep(f: Callable[[Domain], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        SQL[f.__name__] = ("WITH " + ", ".join(_CTE[t] for t in tables) + " " if tables else "") + sql
        return f

    return keep


# reads


@query("SELECT id, tenant_id, name FROM loc WHERE tenant_id = 1 ORDER BY name, id", "loc")
def scoped_locations(d: Domain) -> DataFrame:
    return scope(d.locations(), CTX).orderBy("name", "id")


@query("SELECT id, tenant_id, name FROM loc", "loc")
def unscoped_locations(d: Domain) -> DataFrame:
    return scope(d.locations(), None)


@query("SELECT id, type, name FROM ent WHERE tenant_id = 1", "ent")
def scoped_business_entities(d: Domain) -> DataFrame:
    return scope(d.business_entities(), CTX).select("id", "type", "name")


@query("SELECT id, tenant_id, name FROM bra", "bra")
def unscoped_brands(d: Domain) -> DataFrame:
    return d.brands().select("id", "tenant_id", "name")


@query("SELECT id, name FROM bra WHERE tenant_id = 1", "bra")
def scoped_brands(d: Domain) -> DataFrame:
    return scope(d.brands(), CTX).select("id", "name")


@query("SELECT id, name, company_type FROM com WHERE company_type = 'individual' AND name <> 'Customer#000000001' AND id NOT IN (3, 5)", "com")
def filtered_companies(d: Domain) -> DataFrame:
    return relations.where_all(d.companies(), F.col("company_type") == "individual", F.col("name") != "Customer#000000001", ~F.col("id").isin(3, 5)).select("id", "name", "company_type")


@query("SELECT c.id, c.contractor_type, e.id AS entity_id, e.name AS entity_name FROM con c LEFT JOIN ent e ON c.business_entity_id = e.id AND e.tenant_id = 1", "con", "ent")
def contractors_eager_scoped(d: Domain) -> DataFrame:
    out = relations.belongs_to(d.contractors(), d.business_entities(), "business_entity_id", "entity", ctx=CTX)
    return out.select("id", "contractor_type", F.col("entity.id").alias("entity_id"), F.col("entity.name").alias("entity_name"))


@query("SELECT id, business_entity_id, contractor_type FROM con ORDER BY id DESC", "con")
def contractors_desc(d: Domain) -> DataFrame:
    return d.contractors().orderBy(F.desc("id"))


@query("SELECT id, name FROM loc WHERE id = 7", "loc")
def find_location(d: Domain) -> DataFrame:
    return relations.find(d.locations(), 7).select("id", "name")


@query("SELECT tenant_id, id, name FROM org WHERE parent_id IS NULL AND tenant_id = 1 ORDER BY id LIMIT 1", "org")
def root_organization_by_tenant(d: Domain) -> DataFrame:
    return relations.first_by(d.organizations().filter("parent_id is null and tenant_id = 1"), "id").select("tenant_id", "id", "name")


@query("SELECT p.id, p.name, coalesce(string_agg(c.name, ',' ORDER BY c.name), '') AS children FROM org p LEFT JOIN org c ON c.parent_id = p.id GROUP BY p.id, p.name", "org")
def org_children(d: Domain) -> DataFrame:
    out = relations.nested_children(d.organizations(), d.organizations(), "parent_id", ["name"], "children")
    return out.select("id", "name", F.array_join("children.name", ",").alias("children"))


@query("SELECT c.id, c.name, p.id AS up_id, p.name AS up_name FROM org c LEFT JOIN org p ON c.parent_id = p.id", "org")
def org_parent(d: Domain) -> DataFrame:
    return relations.with_parent(d.organizations()).select("id", "name", F.col("parent.id").alias("up_id"), F.col("parent.name").alias("up_name"))


@query("SELECT e.id, e.type, e.name, com.company_type, con.contractor_type FROM ent e LEFT JOIN com ON com.business_entity_id = e.id LEFT JOIN con ON con.business_entity_id = e.id", "ent", "com", "con")
def subtype_union(d: Domain) -> DataFrame:
    out = relations.belongs_to(d.business_entities(), d.companies(), "id", "c", "business_entity_id")
    out = relations.belongs_to(out, d.contractors(), "id", "k", "business_entity_id")
    return out.select("id", "type", "name", F.col("c.company_type").alias("company_type"), F.col("k.contractor_type").alias("contractor_type"))


@query("SELECT o.id, o.name, e.id AS entity_id, e.name AS entity_name, count(*) AS links FROM org o JOIN oc ON oc.organization_id = o.id JOIN ent e ON e.id = oc.business_entity_id WHERE e.type = 'company' GROUP BY ALL", "org", "oc", "ent")
def group_companies(d: Domain) -> DataFrame:
    out = relations.through(d.organizations(), d.organization_companies(), d.business_entities(), ("id", "organization_id"), ("business_entity_id", "id"), right_filter=F.col("type") == "company")
    return out.groupBy("id", "name", F.col("related_id").alias("entity_id"), F.col("related_name").alias("entity_name")).agg(F.count(F.lit(1)).alias("links"))


@query("SELECT c.id, c.name, coalesce(string_agg(b.name, ',' ORDER BY b.name), '') AS brands FROM com c LEFT JOIN cb ON cb.company_id = c.id LEFT JOIN bra b ON b.id = cb.brand_id GROUP BY c.id, c.name", "com", "cb", "bra")
def company_brands_nested(d: Domain) -> DataFrame:
    links = relations.belongs_to(d.company_brands(), d.brands(), "brand_id", "b").select("company_id", F.col("b.name").alias("brand"))
    return relations.nested_children(d.companies(), links, "company_id", ["brand"], "brands").select("id", "name", F.array_join("brands.brand", ",").alias("brands"))


@query("SELECT b.id, b.name, count(cb.company_id) AS companies FROM bra b LEFT JOIN cb ON cb.brand_id = b.id GROUP BY b.id, b.name", "bra", "cb")
def brand_companies(d: Domain) -> DataFrame:
    n = d.company_brands().groupBy("brand_id").agg(F.count("company_id").alias("n"))
    return d.brands().join(n, F.col("id") == F.col("brand_id"), "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("companies"))


@query("SELECT l.id, l.name, e.id AS entity_id, e.name AS entity_name, lbe.id AS pivot_id, lbe.operational_region_id, lbe.nace_code FROM loc l JOIN lbe ON lbe.location_id = l.id JOIN ent e ON e.id = lbe.business_entity_id", "loc", "lbe", "ent")
def location_entities_with_pivot(d: Domain) -> DataFrame:
    out = relations.through(d.locations(), d.location_business_entities(), d.business_entities(), ("id", "location_id"), ("business_entity_id", "id"), ["id", "operational_region_id", "nace_code"])
    return out.select("id", "name", F.col("related_id").alias("entity_id"), F.col("related_name").alias("entity_name"), F.col("pivot.id").alias("pivot_id"), "pivot.operational_region_id", "pivot.nace_code")


@query("SELECT lbe.id, lbe.location_id, coalesce(string_agg(b.name, ',' ORDER BY b.name), '') AS brands FROM lbe LEFT JOIN cb ON cb.company_id = lbe.business_entity_id LEFT JOIN bra b ON b.id = cb.brand_id GROUP BY lbe.id, lbe.location_id", "lbe", "cb", "bra")
def location_entities_with_brands(d: Domain) -> DataFrame:
    links = relations.belongs_to(d.company_brands(), d.brands(), "brand_id", "b").select("company_id", F.col("b.name").alias("brand"))
    out = relations.nested_children(d.location_business_entities(), links, "company_id", ["brand"], "brands", own_key="business_entity_id")
    return out.select("id", "location_id", F.array_join("brands.brand", ",").alias("brands"))


@query("SELECT id FROM com WHERE EXISTS (SELECT 1 FROM ent WHERE ent.id = com.business_entity_id AND ent.tenant_id = 1)", "com", "ent")
def exists_in_tenant(d: Domain) -> DataFrame:
    return relations.where_has(d.companies(), d.business_entities(), "business_entity_id", condition=F.col("tenant_id") == 1).select("id")


@query("SELECT id FROM com WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = com.id)", "com")
def companies_without_group(d: Domain) -> DataFrame:
    return relations.doesnt_have(d.companies(), d.organization_companies(), "id", "business_entity_id").select("id")


@query("SELECT r.r_regionkey::BIGINT AS id, r.r_name AS name, o.id AS root_id, o.name AS root_name FROM region r LEFT JOIN org o ON o.tenant_id = r.r_regionkey AND o.parent_id IS NULL", "org")
def tenant_document(d: Domain) -> DataFrame:
    roots = d.organizations().filter("parent_id is null").select("tenant_id", F.struct("id", "name").alias("root"))
    return d.tenants().join(roots, F.col("id") == F.col("tenant_id"), "left").select("id", "name", F.col("root.id").alias("root_id"), F.col("root.name").alias("root_name"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'https://files.example.com/storage/' || ltrim('//logos/' || p_name, '/') END AS logo_url FROM part")
def logo_url_derivation(d: Domain) -> DataFrame:
    path = F.when(F.col("p_size") % 3 == 0, F.lit("0")).otherwise(F.concat(F.lit("//logos/"), "p_name"))
    return d.raw("part").select(F.col("p_partkey").alias("id"), C.logo_url(path, "https://files.example.com").alias("logo_url"))


@query("SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'purchase'")
def role_members(d: Domain) -> DataFrame:
    return relations.where_has(d.users(), d.user_roles(), "id", "model_id", F.col("role") == "purchase").select("id")


@query("SELECT user_id AS id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS roles FROM events GROUP BY user_id")
def user_role_names(d: Domain) -> DataFrame:
    return d.user_roles().groupBy(F.col("model_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))


# counts, relational division and reconciliation


@query("SELECT company_type, count(*) AS n FROM com GROUP BY 1", "com")
def count_by_type(d: Domain) -> DataFrame:
    return d.companies().groupBy("company_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT company_id, bool_and(brand_id % 5 <> 1) AS all_present FROM cb GROUP BY company_id", "cb")
def all_present(d: Domain) -> DataFrame:
    return relations.all_present(d.company_brands(), d.brands().filter("tenant_id <> 1").select(F.col("id").alias("brand_id")), "company_id", "brand_id")


#: The desired links move every third company, and all of the last group, to the next of the other groups.
_DESIRED = "CASE WHEN organization_id = 24 OR business_entity_id % 3 = 0 THEN (organization_id + 1) % 24 ELSE organization_id END"
_CURRENT = f"cur AS (SELECT DISTINCT organization_id, business_entity_id FROM oc), des AS (SELECT DISTINCT {_DESIRED} AS organization_id, business_entity_id FROM oc)"


def _sides(d: Domain) -> tuple[DataFrame, DataFrame]:
    links = d.organization_companies().select("organization_id", "business_entity_id").distinct()
    return links, links.withColumn("organization_id", F.expr(_DESIRED)).distinct()


@query(
    f"SELECT organization_id, business_entity_id, CASE WHEN c IS NULL THEN 'attach' WHEN e IS NULL THEN 'detach' ELSE 'keep' END AS action FROM (SELECT *, 1 AS c FROM cur) FULL JOIN (SELECT *, 1 AS e FROM des) USING (organization_id, business_entity_id)",
    "oc",
)
def sync_diff(d: Domain) -> DataFrame:
    return reconcile.sync_diff(*_sides(d), ["organization_id", "business_entity_id"])


@query("SELECT organization_id, business_entity_id FROM cur WHERE organization_id NOT IN (SELECT organization_id FROM des) UNION ALL SELECT organization_id, business_entity_id FROM des", "oc")
def sync_new_state(d: Domain) -> DataFrame:
    return reconcile.sync(*_sides(d), "organization_id", "business_entity_id").select("organization_id", "business_entity_id")


@query("SELECT * FROM cur UNION SELECT * FROM des", "oc")
def attach_if_absent(d: Domain) -> DataFrame:
    return reconcile.attach_if_absent(*_sides(d), ["organization_id", "business_entity_id"])


@query("SELECT * FROM cur UNION ALL SELECT * FROM des", "oc")
def attach_blind(d: Domain) -> DataFrame:
    return reconcile.attach(*_sides(d))


@query("SELECT * FROM cur EXCEPT SELECT * FROM des", "oc")
def detach_pair(d: Domain) -> DataFrame:
    return reconcile.detach(*_sides(d), ["organization_id", "business_entity_id"])


for _name in ("sync_diff", "sync_new_state", "attach_if_absent", "attach_blind", "detach_pair"):
    SQL[_name] = SQL[_name].replace(_CTE["oc"], f"{_CTE['oc']}, {_CURRENT}")


@query("SELECT id, location_id, business_entity_id, CASE WHEN business_entity_id % 7 = 0 THEN 'CHANGED' ELSE nace_code END AS nace_code FROM lbe", "lbe")
def pivot_update_all(d: Domain) -> DataFrame:
    links = d.location_business_entities()
    changes = links.filter("business_entity_id % 7 = 0").select("location_id", "business_entity_id", F.lit("CHANGED").alias("nace_code"))
    return reconcile.update_pivot(links, changes, ["location_id", "business_entity_id"], ["nace_code"]).select("id", "location_id", "business_entity_id", "nace_code")


@query("SELECT company_id, brand_id FROM cb WHERE company_id % 4 <> 0 UNION ALL SELECT DISTINCT company_id, brand_id % 5 FROM cb WHERE company_id % 4 = 0", "cb")
def replace_children(d: Domain) -> DataFrame:
    links = d.company_brands()
    new = links.filter("company_id % 4 = 0").select("company_id", (F.col("brand_id") % 5).alias("brand_id"))
    return reconcile.replace_children(links, new, "company_id", "brand_id")


@query("SELECT id, organization_id, business_entity_id FROM oc a WHERE NOT EXISTS (SELECT 1 FROM oc b WHERE b.business_entity_id = a.business_entity_id AND (b.organization_id < a.organization_id OR (b.organization_id = a.organization_id AND b.id < a.id)))", "oc")
def dedupe_keep_min(d: Domain) -> DataFrame:
    return reconcile.dedupe_keep_min(d.organization_companies(), ["business_entity_id"], ["organization_id", "id"])


# integrity


def _rule(rule_id: str, body: str, *tables: str):
    return query(f"SELECT '{rule_id}' AS rule_id, entity_id, detail FROM ({body})", *tables)


def _faulty(d: Domain) -> DataFrame:
    """Organizations with planted faults: some groups made roots, some their own parents."""
    parent = F.when(F.col("id").isin(3, 8), None).when(F.col("id") == 5, F.col("id")).otherwise(F.col("parent_id"))
    return d.organizations().withColumn("parent_id", parent)


_FAULTY = "(SELECT id, tenant_id, CASE WHEN id IN (3, 8) THEN NULL WHEN id = 5 THEN id ELSE parent_id END AS parent_id FROM org)"


@_rule("single_root", f"SELECT id AS entity_id, 'tenant=' || tenant_id AS detail FROM (SELECT *, min(id) OVER (PARTITION BY tenant_id) AS f FROM {_FAULTY} WHERE parent_id IS NULL) WHERE id > f", "org")
def single_root_violations(d: Domain) -> DataFrame:
    return rules.several_roots(_faulty(d))


@_rule("self_parent", f"SELECT id AS entity_id, 'parent is the row itself' AS detail FROM {_FAULTY} WHERE parent_id = id", "org")
def self_parent_violations(d: Domain) -> DataFrame:
    return rules.own_parents(_faulty(d))


@_rule("same_tenant", "SELECT oc.id AS entity_id, o.tenant_id || '->' || e.tenant_id AS detail FROM oc JOIN org o ON o.id = organization_id JOIN ent e ON e.id = business_entity_id WHERE o.tenant_id <> e.tenant_id", "oc", "org", "ent")
def cross_tenant_links(d: Domain) -> DataFrame:
    o = d.organizations().select(F.col("id").alias("organization_id"), "tenant_id")
    return rules.cross_tenant(d.organization_companies().join(o, "organization_id"), d.business_entities(), "business_entity_id")


@_rule("single_group", "SELECT id AS entity_id, business_entity_id::VARCHAR AS detail FROM (SELECT *, min(id) OVER (PARTITION BY business_entity_id) AS f FROM oc) WHERE id > f", "oc")
def multi_group_companies(d: Domain) -> DataFrame:
    return rules.duplicates(d.organization_companies(), ["business_entity_id"], rule_id="single_group")


@_rule("permanent_contractor", "SELECT lbe.id AS entity_id, coalesce(contractor_type, 'missing') AS detail FROM lbe JOIN ent e ON e.id = lbe.business_entity_id AND e.type = 'contractor' LEFT JOIN con ON con.business_entity_id = e.id WHERE coalesce(contractor_type, 'temporary') = 'temporary'", "lbe", "ent", "con")
def temporary_contractor_links(d: Domain) -> DataFrame:
    return rules.temporary_contractor_links(d.location_business_entities(), d.contractors(), d.business_entities())


@_rule("region_of_location", "SELECT lbe.id AS entity_id, lbe.location_id || '->' || reg.location_id AS detail FROM lbe JOIN reg ON reg.id = operational_region_id WHERE lbe.location_id <> reg.location_id", "lbe", "reg")
def region_not_in_location(d: Domain) -> DataFrame:
    return rules.regions_elsewhere(d.location_business_entities(), d.operational_regions())


_LB = "lb AS (SELECT id * 10 + i AS id, id AS link, 11 + (business_entity_id + i * 7) % 45 AS brand_id FROM lbe, (SELECT unnest([1, 2]) AS i))"


@_rule("brand_of_company", "SELECT lb.id AS entity_id, 'brand=' || lb.brand_id AS detail FROM lb JOIN lbe ON lbe.id = link JOIN ent e ON e.id = lbe.business_entity_id WHERE e.type <> 'company' OR NOT EXISTS (SELECT 1 FROM cb WHERE cb.company_id = lbe.business_entity_id AND cb.brand_id = lb.brand_id)", "lbe", "ent", "cb")
def brand_not_of_company(d: Domain) -> DataFrame:
    links = d.location_business_entities()
    two = links.select(F.col("id").alias("location_business_entity_id"), "business_entity_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("i"))
    brands = two.select((F.col("location_business_entity_id") * 10 + F.col("i")).alias("id"), "location_business_entity_id", (11 + (F.col("business_entity_id") + F.col("i") * 7) % 45).alias("brand_id"))
    return rules.foreign_brands(brands, links, d.business_entities(), d.companies(), d.company_brands())


SQL["brand_not_of_company"] = SQL["brand_not_of_company"].replace(_CTE["lbe"], f"{_CTE['lbe']}, {_LB}")


@_rule("unique", "SELECT id AS entity_id, location_id || '|' || region AS detail FROM (SELECT id, location_id, operational_region_id AS region, min(id) OVER (PARTITION BY location_id, operational_region_id) AS f FROM lbe WHERE operational_region_id IS NOT NULL) WHERE id > f", "lbe")
def unique_null_aware(d: Domain) -> DataFrame:
    return rules.duplicates(d.location_business_entities(), ["location_id", "operational_region_id"])


@_rule("exists", "SELECT id AS entity_id, 'operational_region_id=' || operational_region_id AS detail FROM lbe WHERE operational_region_id IS NOT NULL AND operational_region_id NOT IN (SELECT id FROM reg WHERE tenant_id <> 2)", "lbe", "reg")
def fk_orphans(d: Domain) -> DataFrame:
    return rules.orphans(d.location_business_entities(), d.operational_regions().filter("tenant_id <> 2"), "operational_region_id")


@_rule("in", "SELECT c_custkey AS entity_id, c_mktsegment AS detail FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def enum_domain_violations(d: Domain) -> DataFrame:
    return rules.outside_domain(d.raw("customer"), "c_mktsegment", ("BUILDING", "MACHINERY"), "c_custkey")


@_rule("name_drift", "SELECT com.id AS entity_id, (CASE WHEN com.id % 10 = 0 THEN upper(com.name) ELSE com.name END) || ' <> ' || ent.name AS detail FROM com JOIN ent ON ent.id = com.business_entity_id WHERE com.id % 10 = 0 AND upper(com.name) <> ent.name", "com", "ent")
def name_drift(d: Domain) -> DataFrame:
    renamed = d.companies().withColumn("name", F.when(F.col("id") % 10 == 0, F.upper("name")).otherwise(F.col("name")))
    return rules.name_drift(renamed, d.business_entities())


@query("SELECT 'locations' AS child, count(*) AS n FROM loc WHERE tenant_id = 2 UNION ALL SELECT 'entities', count(*) FROM ent WHERE tenant_id = 2 UNION ALL SELECT 'links', count(*) FROM lbe WHERE location_id IN (SELECT id FROM loc WHERE tenant_id = 2) OR business_entity_id IN (SELECT id FROM ent WHERE tenant_id = 2)", "loc", "ent", "lbe")
def cascade_delete_impact(d: Domain) -> DataFrame:
    state = {"tenants": d.tenants(), "locations": d.locations(), "business_entities": d.business_entities(), "location_business_entities": d.location_business_entities()}
    _, _, went = referential.delete_keys(state, "tenants", d.tenants().filter("id = 2"))
    named = {"locations": "locations", "business_entities": "entities", "location_business_entities": "links"}
    gone = [went[t].select(F.lit(n).alias("child")) for t, n in named.items()]
    return functools.reduce(DataFrame.union, gone).groupBy("child").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT com.id, com.business_entity_id FROM com JOIN ent ON ent.id = com.business_entity_id WHERE ent.tenant_id = 2", "com", "ent")
def restrict_blockers(d: Domain) -> DataFrame:
    state = {"business_entities": d.business_entities(), "companies": d.companies()}
    _, found = referential.delete(state, "business_entities", d.business_entities().filter("tenant_id = 2"))
    return found.select(F.col("entity_id").alias("id"), F.regexp_extract("detail", "=(.*)", 1).try_cast("long").alias("business_entity_id"))


@query("SELECT lbe.id, CASE WHEN reg.tenant_id = 2 THEN NULL ELSE operational_region_id END AS operational_region_id FROM lbe LEFT JOIN reg ON reg.id = operational_region_id", "lbe", "reg")
def set_null_effect(d: Domain) -> DataFrame:
    state = {"operational_regions": d.operational_regions(), "location_business_entities": d.location_business_entities()}
    new, _ = referential.delete(state, "operational_regions", d.operational_regions().filter("tenant_id = 2"))
    return new["location_business_entities"].select("id", "operational_region_id")


@query("SELECT c_custkey AS id, concat_ws(',', CASE WHEN c_name NOT SIMILAR TO '[A-Za-z0-9_-]+' THEN 'alpha_dash' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE') THEN 'in' END, CASE WHEN length(c_name) > 17 THEN 'max' END) AS broken FROM customer")
def validation_failures(d: Domain) -> DataFrame:
    checks = {"alpha_dash": C.alpha_dash(F.col("c_name")), "in": C.one_of(F.col("c_mktsegment"), "BUILDING", "AUTOMOBILE"), "max": C.max_length(F.col("c_name"), 17)}
    return d.raw("customer").select(F.col("c_custkey").alias("id"), F.array_join(C.failures(checks), ",").alias("broken"))


# commands: the rows of the new state and the violations


def _outcome(result: commands.Result, **tables: str) -> DataFrame:
    """(part, id, value): for each named table one column of its new rows, and the violations as part broken."""
    new, found = result
    parts = [new[t].select(F.lit(t).alias("part"), "id", F.col(c).cast("string").alias("value")) for t, c in tables.items()]
    parts.append(found.select(F.lit("broken").alias("part"), F.col("entity_id").alias("id"), F.col("rule_id").alias("value")))
    return functools.reduce(DataFrame.unionByName, parts)


_LINKED = ("locations", "business_entities", "contractors", "companies", "operational_regions", "location_business_entities")
_ONE = f"business_entity_id = {SUPPLIER_BASE + 1}"


@query(f"SELECT 'contractors' AS part, id, CASE WHEN id = 1 THEN 'temporary' ELSE contractor_type END AS value FROM con UNION ALL SELECT 'business_entities', id, CASE WHEN id = {SUPPLIER_BASE + 1} THEN 'renamed' ELSE name END FROM ent", "con", "ent")
def update_contractor(d: Domain) -> DataFrame:
    state = d.state("tenants", "business_entities", "contractors")
    return _outcome(commands.update_contractor(state, 1, "renamed", "temporary"), contractors="contractor_type", business_entities="name")


@query(f"SELECT 'contractors' AS part, id, contractor_type AS value FROM con WHERE id <> 1 UNION ALL SELECT 'business_entities', id, name FROM ent WHERE id <> {SUPPLIER_BASE + 1} UNION ALL SELECT 'location_business_entities', id, nace_code FROM lbe WHERE NOT {_ONE}", "con", "ent", "lbe")
def delete_contractor(d: Domain) -> DataFrame:
    gone = commands.delete_contractor(d.state(*_LINKED), None, 1)
    return _outcome(gone, contractors="contractor_type", business_entities="name", location_business_entities="nace_code")


@query(f"SELECT 'location_business_entities' AS part, id, CASE WHEN {_ONE} AND location_id = 3 THEN 34 ELSE operational_region_id END::VARCHAR AS value FROM lbe UNION ALL SELECT 'broken', id, 'region_of_location' FROM lbe WHERE {_ONE} AND location_id = 3 UNION ALL SELECT 'broken', lbe.id, 'permanent_contractor' FROM lbe JOIN con USING (business_entity_id) WHERE {_ONE} AND location_id = 3 AND contractor_type = 'temporary'", "con", "lbe")
def update_location_link(d: Domain) -> DataFrame:
    changes = {"nace_code": "NEW", "operational_region_id": 34}
    return _outcome(commands.update_link(d.state(*_LINKED), 3, SUPPLIER_BASE + 1, changes), location_business_entities="operational_region_id")


@query(f"SELECT 'location_business_entities' AS part, id, nace_code AS value FROM lbe WHERE NOT ({_ONE} AND location_id = 3)", "lbe")
def detach_location_link(d: Domain) -> DataFrame:
    return _outcome(commands.unlink_entity(d.state(*_LINKED), 3, SUPPLIER_BASE + 1), location_business_entities="nace_code")


@query("SELECT 'organization_companies' AS part, id, organization_id::VARCHAR AS value FROM new UNION ALL SELECT 'broken', id, 'organization_companies.business_entity_id.unique' FROM new WHERE business_entity_id = 5 AND id > (SELECT min(id) FROM new WHERE business_entity_id = 5) UNION ALL SELECT 'broken', -1, 'group_company' FROM org, ent WHERE org.id = 3 AND ent.id = 5 AND org.tenant_id <> ent.tenant_id", "oc", "org", "ent")
def attach_group_company(d: Domain) -> DataFrame:
    state = d.state("organizations", "business_entities", "organization_companies")
    return _outcome(commands.attach_group_company(state, -1, 3, 5), organization_companies="organization_id")


SQL["attach_group_company"] = SQL["attach_group_company"].replace(_CTE["oc"], f"{_CTE['oc']}, new AS (SELECT id, organization_id, business_entity_id FROM oc UNION ALL SELECT -1, 3, 5 WHERE NOT EXISTS (SELECT 1 FROM oc WHERE organization_id = 3 AND business_entity_id = 5))")


@query("SELECT 'organization_companies' AS part, id, organization_id::VARCHAR AS value FROM oc WHERE NOT (organization_id = 1 AND business_entity_id = 4) UNION ALL SELECT 'broken', NULL, 'group_company' FROM org, ent WHERE org.id = 1 AND ent.id = 4 AND org.tenant_id <> ent.tenant_id", "oc", "org", "ent")
def detach_group_company(d: Domain) -> DataFrame:
    state = d.state("organizations", "business_entities", "organization_companies")
    return _outcome(commands.detach_group_company(state, 1, 4), organization_companies="organization_id")


@query("SELECT 'operational_regions' AS part, id, CASE WHEN id = 11 THEN 'renamed' ELSE name END AS value FROM reg", "reg")
def update_region(d: Domain) -> DataFrame:
    state = d.state("tenants", "locations", "operational_regions")
    return _outcome(commands.update_region(state, CTX, 1, 11, {"name": "renamed"}), operational_regions="name")


@query("SELECT 'operational_regions' AS part, id, name AS value FROM reg WHERE id <> 14 UNION ALL SELECT 'location_business_entities', id, CASE WHEN operational_region_id <> 14 THEN operational_region_id END::VARCHAR FROM lbe UNION ALL SELECT 'broken', 14, 'region_of_location'", "reg", "lbe")
def delete_region(d: Domain) -> DataFrame:
    """Region 14 is booked on location 2."""
    return _outcome(commands.delete_region(d.state(*_LINKED), CTX, 1, 14), operational_regions="name", location_business_entities="operational_region_id")


@query("SELECT 'operational_regions' AS part, id, name AS value FROM reg UNION ALL SELECT 'operational_regions', -5, 'lost' UNION ALL SELECT 'broken', -5, 'operational_regions.location_id.exists'", "reg")
def create_region_nowhere(d: Domain) -> DataFrame:
    state = d.state("tenants", "locations", "operational_regions")
    return _outcome(commands.create_region(state, 999, id=-5, name="lost", type="office"), operational_regions="name")


@query("SELECT 'locations' AS part, id, CASE WHEN id = 0 THEN 'moved' ELSE name END AS value FROM loc UNION ALL SELECT 'broken', 0, 'locations.tenant'", "loc")
def update_other_tenants_location(d: Domain) -> DataFrame:
    return _outcome(commands.update_location(d.state("tenants", "locations"), CTX, 0, {"name": "moved", "tenant_id": 1}), locations="name")


@query("SELECT 'companies' AS part, id, 'corporate' AS value FROM com", "com")
def bulk_update(d: Domain) -> DataFrame:
    state = d.state("business_entities", "companies")
    return _outcome(commands.update_where(state, "companies", F.col("company_type") == "individual", {"company_type": "corporate"}), companies="company_type")


@query("SELECT 'locations' AS part, id, name AS value FROM loc WHERE tenant_id <> 3 UNION ALL SELECT 'location_business_entities', lbe.id, nace_code FROM lbe JOIN loc ON loc.id = location_id WHERE tenant_id <> 3", "loc", "lbe")
def bulk_delete(d: Domain) -> DataFrame:
    state = d.state("locations", "location_business_entities")
    return _outcome(commands.delete_where(state, "locations", F.col("tenant_id") == 3), locations="name", location_business_entities="nace_code")


@query("SELECT 'organizations' AS part, id, CASE WHEN id = 1001 THEN 'renamed' ELSE name END AS value FROM org", "org")
def rename_root(d: Domain) -> DataFrame:
    state = d.state("tenants", "organizations")
    return _outcome(commands.update_organization(state, CTX, 1001, {"name": "renamed"}), organizations="name")


@_rule("no_cycle", "SELECT id AS entity_id, 'parent=' || CASE id WHEN 3 THEN 4 ELSE 3 END AS detail FROM org WHERE id IN (3, 4, 5)", "org")
def organization_cycles(d: Domain) -> DataFrame:
    """3 and 4 are made each other's parent, 5 lies below them."""
    parent = F.when(F.col("id") == 3, 4).when(F.col("id").isin(4, 5), 3).otherwise(F.col("parent_id"))
    return rules.endless_parents(d.organizations().withColumn("parent_id", parent))


@_rule("one_brand", "SELECT location_id AS entity_id, 'brands=' || count(DISTINCT 11 + business_entity_id % 45) AS detail FROM lbe GROUP BY location_id HAVING count(DISTINCT 11 + business_entity_id % 45) > 1", "lbe")
def brands_per_location(d: Domain) -> DataFrame:
    links = d.location_business_entities()
    brands = links.select(F.col("id").alias("location_business_entity_id"), (11 + F.col("business_entity_id") % 45).alias("brand_id"))
    return rules.several_brands(brands, links)


@query("SELECT DISTINCT user_id::BIGINT AS id, 'user-' || user_id AS name FROM events")
def visible_users(d: Domain) -> DataFrame:
    return visible(d.users(), "users")
