"""Registered queries of commands, sources and validation: each gives the new rows and the violations, beside SQL for both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import metadata, tables
from ..sources.workspace import Workspace, new_dir
from . import commands
from .mapping import SUPPLIER_BASE, Domain
from .queries import CTX, SQL, _outcome, query

# tenants and organizations


@query("SELECT 'tenants' AS part, r_regionkey::BIGINT AS id, lower(r_name) AS value FROM region UNION ALL SELECT 'tenants', 99, 'ASIA ' UNION ALL SELECT 'broken', 99, 'tenants.slug.unique' FROM region WHERE lower(r_name) = 'asia' UNION ALL SELECT 'broken', 99, 'tenants.slug.alpha_dash'")
def create_tenant(d: Domain) -> DataFrame:
    """The slug is another tenant's but for case and a trailing space, which no slug may have."""
    return _outcome(commands.create_tenant(d.state("tenants"), id=99, name="new", slug="ASIA "), tenants="slug")


@query("SELECT 'tenants' AS part, r_regionkey::BIGINT AS id, CASE WHEN r_regionkey = 2 THEN 'two' ELSE lower(r_name) END AS value FROM region UNION ALL SELECT 'logo', r_regionkey, 'logos/' || r_name FROM region WHERE r_regionkey = 2")
def update_tenant(d: Domain) -> DataFrame:
    """A new slug and logo; the logo that no tenant has any more."""
    state = d.state("tenants")
    state["tenants"] = state["tenants"].withColumn("logo_path", F.concat(F.lit("logos/"), "name"))
    new = commands.update_tenant(state, 2, {"slug": "two", "logo_path": "logos/new"})
    return _outcome(new, tenants="slug").unionByName(commands.replaced_logos(state, new[0]).select(F.lit("logo").alias("part"), "id", F.col("logo_path").alias("value")))


@query("SELECT 'tenants' AS part, r_regionkey::BIGINT AS id, lower(r_name) AS value FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 'locations', id, name FROM loc WHERE tenant_id <> 2 UNION ALL SELECT 'business_entities', id, name FROM ent WHERE tenant_id <> 2 UNION ALL SELECT 'contractors', con.id, contractor_type FROM con JOIN ent ON ent.id = con.business_entity_id WHERE tenant_id <> 2 UNION ALL SELECT 'brands', id, name FROM bra WHERE tenant_id <> 2 UNION ALL SELECT 'broken', com.id, 'companies.business_entity_id.restrict' FROM com JOIN ent ON ent.id = com.business_entity_id WHERE tenant_id = 2", "loc", "ent", "con", "com", "bra")
def delete_tenant(d: Domain) -> DataFrame:
    state = d.state("tenants", "organizations", "locations", "business_entities", "companies", "contractors", "operational_regions", "brands")
    return _outcome(commands.delete_tenant(state, 2), tenants="slug", locations="name", business_entities="name", contractors="contractor_type", brands="name")


@query("SELECT 'organizations' AS part, id, name AS value FROM org UNION ALL SELECT 'organizations', 500, 'below' UNION ALL SELECT 'organizations', 2001, 'second' UNION ALL SELECT 'broken', 2001, 'single_root' FROM org WHERE id = 1001 UNION ALL SELECT 'organizations', 501, 'elsewhere' UNION ALL SELECT 'broken', 1002, 'parent_in_tenant'", "org")
def create_organizations(d: Domain) -> DataFrame:
    """One below the tenant's root, a second root, and one below another tenant's root."""
    first, a = commands.create_organization(d.state("tenants", "organizations"), CTX, id=500, name="below", type="group", parent_id=1001)
    second, b = commands.create_organization(first, CTX, id=2001, name="second", type="holding")
    third, c = commands.create_organization(second, CTX, id=501, name="elsewhere", type="group", parent_id=1002)
    return _outcome((third, a.unionByName(b).unionByName(c)), organizations="name")


@query("SELECT 'organizations' AS part, id, name AS value FROM org WHERE id <> 1001 UNION ALL SELECT 'broken', id, 'organizations.parent_id.restrict' FROM org WHERE parent_id = 1001", "org")
def delete_organization(d: Domain) -> DataFrame:
    return _outcome(commands.remove(d.state("tenants", "organizations"), "organizations", 1001, CTX), organizations="name")


# companies, brands and groups


@query("SELECT 'companies' AS part, id, company_type AS value FROM com UNION ALL SELECT 'companies', -1, 'corporate' UNION ALL SELECT 'business_entities', id, name FROM ent UNION ALL SELECT 'business_entities', -2, 'fresh'", "com", "ent")
def create_company(d: Domain) -> DataFrame:
    new = commands.create_company(d.state("tenants", "business_entities", "companies"), CTX, -2, -1, "fresh", "corporate")
    return _outcome(new, companies="company_type", business_entities="name")


@query("SELECT 'companies' AS part, id, name || '/' || CASE WHEN id = 1 THEN 'individual' ELSE company_type END AS value FROM com UNION ALL SELECT 'business_entities', id, CASE WHEN id = 1 THEN 'renamed' ELSE name END FROM ent", "com", "ent")
def update_company(d: Domain) -> DataFrame:
    """The type changes on the company and the name on its entity only."""
    new, found = commands.update_company(d.state("tenants", "business_entities", "companies"), 1, "individual", "renamed")
    both = new["companies"].withColumn("name", F.concat_ws("/", "name", "company_type"))
    return _outcome((new | {"companies": both}, found), companies="name", business_entities="name")


_GONE = "SELECT id FROM ent WHERE id = 4 AND tenant_id = 1"


@query(f"SELECT 'companies' AS part, id, company_type AS value FROM com WHERE id <> 4 UNION ALL SELECT 'business_entities', id, name FROM ent WHERE id NOT IN ({_GONE}) UNION ALL SELECT 'location_business_entities', id, nace_code FROM lbe WHERE business_entity_id NOT IN ({_GONE})", "com", "ent", "lbe")
def delete_company(d: Domain) -> DataFrame:
    """The company, then its entity with its links, if that is the tenant's."""
    state = d.state("locations", "business_entities", "companies", "operational_regions", "location_business_entities")
    return _outcome(commands.delete_company(state, CTX, 4), companies="company_type", business_entities="name", location_business_entities="nace_code")


@query("SELECT 'brands' AS part, id, name AS value FROM bra UNION ALL SELECT 'brands', 99, 'fresh' UNION ALL SELECT 'company_brands', company_id, brand_id::VARCHAR FROM cb UNION ALL SELECT 'company_brands', c, '99' FROM asked UNION ALL SELECT 'broken', c, 'company_in_tenant' FROM asked WHERE c NOT IN (SELECT com.id FROM com JOIN ent ON ent.id = com.business_entity_id WHERE tenant_id = 1)", "bra", "cb", "com", "ent")
def create_brand(d: Domain) -> DataFrame:
    """A brand of three companies, not all of which are the tenant's."""
    state = d.state("tenants", "business_entities", "companies", "brands", "company_brands")
    state["company_brands"] = Workspace(d.spark).write(state["company_brands"])  # read several times, derived once
    new, found = commands.create_brand(state, CTX, [1, 2, 3], id=99, name="fresh")
    carried = new["company_brands"].select(F.lit("company_brands").alias("part"), F.col("company_id").alias("id"), F.col("brand_id").cast("string").alias("value"))
    return _outcome((new, found), brands="name").unionByName(carried)


SQL["create_brand"] = SQL["create_brand"].replace(" SELECT 'brands'", ", asked AS (SELECT unnest([1, 2, 3])::BIGINT AS c) SELECT 'brands'", 1)

_WANTED = "w AS (SELECT -(id + 1) AS id, id AS e FROM ent WHERE type = 'company' AND tenant_id = (SELECT tenant_id FROM org WHERE id = 3)), new AS (SELECT id, organization_id, business_entity_id FROM oc WHERE organization_id <> 3 OR business_entity_id IN (SELECT e FROM w) UNION ALL SELECT id, 3, e FROM w WHERE e NOT IN (SELECT business_entity_id FROM oc WHERE organization_id = 3)), least AS (SELECT business_entity_id AS e, min(id) AS m FROM new GROUP BY 1)"


@query("SELECT 'organization_companies' AS part, id, organization_id::VARCHAR AS value FROM new UNION ALL SELECT 'broken', id, 'organization_companies.business_entity_id.unique' FROM new JOIN least ON e = business_entity_id WHERE id > m AND business_entity_id IN (SELECT business_entity_id FROM new WHERE organization_id = 3)", "oc", "org", "ent")
def set_group_companies(d: Domain) -> DataFrame:
    """A group gets all companies of its tenant; those that are in other groups as well break the rule of one group."""
    own = d.organizations().filter("id = 3").select("tenant_id")
    wanted = d.business_entities().filter("type = 'company'").join(own, "tenant_id", "left_semi").select((-(F.col("id") + 1)).alias("id"), F.col("id").alias("business_entity_id"))
    return _outcome(commands.set_group_companies(d.state("organizations", "business_entities", "organization_companies"), 3, wanted), organization_companies="organization_id")


SQL["set_group_companies"] = SQL["set_group_companies"].replace(" SELECT 'organization_companies' AS part", f", {_WANTED} SELECT 'organization_companies' AS part", 1)


@query("SELECT 'tenants' AS part, r_regionkey::BIGINT AS id, lower(r_name) AS value FROM region UNION ALL SELECT 'tenants', 77, 'fresh' UNION ALL SELECT 'organizations', id, type FROM org UNION ALL SELECT 'organizations', 7000, 'group' UNION ALL SELECT 'companies', id, company_type FROM com UNION ALL SELECT 'companies', -1, 'corporate' UNION ALL SELECT 'business_entities', id, name FROM ent UNION ALL SELECT 'business_entities', -1, 'first' UNION ALL SELECT 'locations', id, name FROM loc UNION ALL SELECT 'locations', 700, 'here' UNION ALL SELECT 'organization_companies', id, organization_id::VARCHAR FROM oc UNION ALL SELECT 'organization_companies', -1, '7000'", "org", "com", "ent", "loc", "oc")
def onboarding(d: Domain) -> DataFrame:
    """A tenant with its root group, a first company in it and a location."""
    ids = {"tenant": 77, "organization": 7000, "entity": -1, "company": -1, "link": -1, "location": 700}
    state = d.state("tenants", "organizations", "business_entities", "companies", "locations", "organization_companies")
    new = commands.onboard(state, "group", ids, tenant={"name": "fresh", "slug": "fresh"}, organization={"name": "root"}, company={"name": "first", "company_type": "corporate"}, location={"name": "here"})
    return _outcome(new, tenants="slug", organizations="type", companies="company_type", business_entities="name", locations="name", organization_companies="organization_id")


@query(f"SELECT 'location_business_entities' AS part, id, nace_code AS value FROM lbe UNION ALL SELECT 'location_business_entities', -1, 'NEW' UNION ALL SELECT 'location_business_entities', -2, 'ODD' UNION ALL SELECT 'broken', -1, 'brand_of_company' WHERE NOT EXISTS (SELECT 1 FROM cb WHERE company_id = 1 AND brand_id = 11) UNION ALL SELECT 'broken', -1, 'location_business_entity_brands.brand_id.exists' WHERE NOT EXISTS (SELECT 1 FROM bra WHERE id = 11) UNION ALL SELECT 'broken', -2, 'region_of_location' UNION ALL SELECT 'broken', -2, 'permanent_contractor' FROM con WHERE business_entity_id = {SUPPLIER_BASE + 1} AND contractor_type = 'temporary'", "lbe", "cb", "bra", "con")
def attach_location_links(d: Domain) -> DataFrame:
    """A company with a brand at a location, and a contractor in another location's region."""
    state = d.state("tenants", "locations", "business_entities", "companies", "contractors", "operational_regions", "location_business_entities", "brands", "company_brands")
    first, a = commands.link_entity(state, [(-1, 11)], id=-1, location_id=3, business_entity_id=1, nace_code="NEW", hazard_class="low")
    second, b = commands.link_entity(first, id=-2, location_id=3, business_entity_id=SUPPLIER_BASE + 1, operational_region_id=44, nace_code="ODD", hazard_class="low")
    return _outcome((second, a.unionByName(b)), location_business_entities="nace_code")


@query("SELECT id, company_type = 'individual' AS touched FROM com", "com")
def touched_rows(d: Domain) -> DataFrame:
    """Rows that a bulk change gives a time of change."""
    new, _ = commands.update_where(d.state("business_entities", "companies"), "companies", F.col("company_type") == "individual", {"company_type": "corporate"})
    return new["companies"].select("id", F.col("updated_at").isNotNull().alias("touched"))


# sources


@query("SELECT 'locations' AS part, id, name AS value FROM loc WHERE tenant_id = 1 UNION ALL SELECT 'business_entities', id, name FROM ent WHERE tenant_id = 1 UNION ALL SELECT 'companies', id, company_type FROM com", "loc", "ent", "com")
def snapshot_scans(d: Domain) -> DataFrame:
    """Tables of a snapshot, read back with a context: scoped ones keep the tenant's rows, others all."""
    root = new_dir(d.spark)
    tables.snapshot({n: df for n, df in d.state("locations", "business_entities", "companies").items() if n in ("locations", "business_entities", "companies")}, root)
    rows = lambda n, c: tables.scan(d.spark, root, n, CTX).select(F.lit(n).alias("part"), "id", F.col(c).alias("value"))
    return rows("locations", "name").unionByName(rows("business_entities", "name")).unionByName(rows("companies", "company_type"))


@query("SELECT id, location_id, operational_region_id, nace_code FROM lbe", "lbe")
def snapshot_restored(d: Domain) -> DataFrame:
    root = new_dir(d.spark)
    tables.snapshot({"location_business_entities": d.state("location_business_entities")["location_business_entities"]}, root)
    return tables.restore(d.spark, root, ["location_business_entities"])["location_business_entities"].select("id", "location_id", "operational_region_id", "nace_code")


@query("""SELECT '{"data":{"id":' || id || ',"operational_region_id":' || coalesce(operational_region_id::VARCHAR, 'null') || ',"nace_code":"' || nace_code || '"}}' AS document FROM lbe""", "lbe")
def json_documents(d: Domain) -> DataFrame:
    return tables.to_documents(d.location_business_entities().select("id", "operational_region_id", "nace_code"))


@query("SELECT id, name FROM ent UNION ALL SELECT NULL, NULL FROM ent", "ent")
def json_requests(d: Domain) -> DataFrame:
    """Documents with members that are not allowed, each followed by one that is no JSON, read back."""
    path, rows = new_dir(d.spark), d.business_entities().withColumn("is_admin", F.lit(True))
    good = tables.to_documents(rows, wrapped=False).select(F.col("document").alias("value"))
    good.unionByName(rows.select(F.concat(F.lit("{broken "), "id").alias("value"))).write.text(path)
    return tables.read_documents(d.spark, path, "id long, name string, is_admin boolean", ["id", "name"])


@query("SELECT id, name FROM bra UNION ALL SELECT NULL, name FROM (SELECT DISTINCT p_type AS name FROM part) WHERE name NOT IN (SELECT name FROM bra)", "bra")
def seeded_brands(d: Domain) -> DataFrame:
    wanted = d.raw("part").select(F.col("p_type").alias("name")).unionByName(d.brands().select("name"))
    return tables.first_or_create(d.brands().select("id", "name"), wanted, ["name"]).select("id", "name")


@query("SELECT table_name AS tab, column_name AS col, (ordinal_position - 1)::INTEGER AS at FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events')")
def schema_columns(d: Domain) -> DataFrame:
    """The columns of the given tables, from their schemas alone."""
    return metadata.columns({t: d.raw(t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}).select("tab", "col", "at")


# validation and derived columns


@query("SELECT o_orderkey AS id, concat_ws(',', CASE WHEN o_orderpriority NOT SIMILAR TO '[01].*' THEN 'boolean' END, CASE WHEN o_custkey = o_orderkey % 100 THEN 'different' END, CASE WHEN o_orderkey % 3 = o_custkey % 3 THEN 'distinct' END, CASE WHEN o_orderkey % 5 = 0 THEN 'email' END, CASE WHEN o_orderkey % 2 = 1 THEN 'integer' END, CASE WHEN o_orderkey % 7 = 0 THEN 'required' END, CASE WHEN o_orderkey % 4 = 0 AND o_orderstatus = 'F' THEN 'required_if' END) AS broken FROM orders")
def request_failures(d: Domain) -> DataFrame:
    """The rules that requests made of orders break."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    digits = F.col("o_orderpriority").substr(F.lit(1), (1 + key % 2).cast("int"))
    checks = {
        "boolean": C.is_boolean(F.substring("o_orderpriority", 1, 1)),
        "different": C.different(F.col("o_custkey"), key % 100),
        "distinct": C.distinct_items(F.array(key % 3, F.col("o_custkey") % 3), 1),
        "email": C.email(F.concat(status, F.when(key % 5 == 0, " ").otherwise("@"), F.lit("x.org"))),
        "integer": C.is_integer(digits),
        "required": C.required(F.when(key % 7 == 0, " ").otherwise(status)),
        "required_if": C.required_if(F.when(key % 4 != 0, status), status == "F"),
    }
    return d.raw("orders").select(key.alias("id"), F.array_join(C.failures(checks), ",").alias("broken"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END ELSE o_orderstatus END AS value, format('{:,.2f}', o_orderkey * 37 / 1024.0::DOUBLE) AS size FROM orders")
def derived_columns(d: Domain) -> DataFrame:
    """A patched column, where a member that is there may be null, and a size in kilobytes."""
    key = F.col("o_orderkey")
    value = C.patched(key % 2 == 0, F.when(key % 4 != 0, F.col("o_orderpriority")), F.col("o_orderstatus"))
    return d.raw("orders").select(key.alias("id"), value.alias("value"), C.size_kb(key * 37).alias("size"))
