"""Sources, commands, rules, validation predicates and streams: one accepted and one rejected case each."""

import pytest
from pyspark.sql import functions as F

from tenantry.context import TenantContext, scope
from tenantry.functions import columns as C
from tenantry.operators import reconcile, relations, rules
from tenantry.plans import commands as cmd
from tenantry.schema import TABLES
from tenantry.sources import tables
from tenantry.streaming import scoped

CTX = TenantContext(1)


@pytest.fixture(scope="module")
def state(spark):
    s = {n: spark.createDataFrame([], t.struct) for n, t in TABLES.items()}

    def put(name, /, **values):
        s[name] = s[name].unionByName(cmd.row(s, name, **values))

    put("tenants", id=1, name="A", slug="a", status=True)
    put("tenants", id=2, name="B", slug="b", status=True)
    put("organizations", id=1, tenant_id=1, name="root", type="holding")
    put("organizations", id=2, tenant_id=1, parent_id=1, name="grp", type="group")
    put("organizations", id=3, tenant_id=2, name="other", type="group")
    put("business_entities", id=10, tenant_id=1, type="company", name="co")
    put("business_entities", id=11, tenant_id=1, type="contractor", name="tmp")
    put("companies", id=1, business_entity_id=10, name="co", company_type="corporate")
    put("contractors", id=1, business_entity_id=11, contractor_type="temporary")
    put("locations", id=5, tenant_id=1, name="here")
    put("locations", id=6, tenant_id=1, name="there")
    put("operational_regions", id=7, tenant_id=1, location_id=6, name="yard", type="depot", is_active=True)
    put("brands", id=1, tenant_id=1, name="x")
    put("company_brands", company_id=1, brand_id=1)
    return {n: df.cache() for n, df in s.items()}


def broken(result):
    return sorted({r["rule_id"] for r in result[1].collect()})


def test_scope(state):
    assert scope(state["locations"], CTX).count() == 2 and scope(state["locations"], TenantContext(2)).isEmpty() and scope(state["tenants"], None).count() == 2
    with pytest.raises(PermissionError):
        cmd.create_organization(state, None, id=9, name="n")
    with pytest.raises(LookupError):
        relations.find(state["brands"], 99)


def test_organizations(state):
    assert broken(cmd.create_organization(state, CTX, id=9, name="n", type="group", parent_id=1)) == []
    assert broken(cmd.create_organization(state, CTX, id=9, name="n", type="group")) == ["single_root"]
    assert broken(cmd.create_organization(state, CTX, id=9, name="n", type="group", parent_id=3)) == ["parent_in_tenant"]
    assert "self_parent" in broken(cmd.update_organization(state, CTX, 2, {"parent_id": 2}))
    assert "organizations.tenant" in broken(cmd.update_organization(state, CTX, 3, {"name": "z"}))
    assert "organizations.type.in" in broken(cmd.create_organization(state, CTX, id=9, name="n", type="brand", parent_id=1))


def test_companies_and_groups(state, spark):
    new = cmd.create_company(state, CTX, 20, 2, "two", "individual")
    assert broken(new) == []
    renamed = cmd.update_company(state, 1, name="new")
    assert [r["detail"] for r in rules.name_drift(renamed[0]["companies"], renamed[0]["business_entities"]).collect()] == ["co <> new"]
    gone = cmd.delete_company(state, CTX, 1)
    assert gone[1].isEmpty() and gone[0]["business_entities"].count() == 1 and gone[0]["company_brands"].isEmpty()
    link = spark.createDataFrame([(1, 10)], "id long, business_entity_id long")
    assert broken(cmd.set_group_companies(state, 2, link)) == []
    assert broken(cmd.set_group_companies(state, 1, link)) == ["group_company"]
    assert broken(cmd.set_group_companies(state, 3, link)) == ["group_company"]


def test_links(state):
    base = {"id": 1, "location_id": 5, "nace_code": "n", "hazard_class": "h"}
    assert broken(cmd.link_entity(state, [(1, 1)], business_entity_id=10, **base)) == []
    assert broken(cmd.link_entity(state, business_entity_id=11, **base)) == ["permanent_contractor"]
    assert broken(cmd.link_entity(state, business_entity_id=10, operational_region_id=7, **base)) == ["region_of_location"]
    assert "brand_of_company" in broken(cmd.link_entity(state, [(1, 9)], business_entity_id=10, **base))
    assert broken(cmd.set_company_brands(state, CTX, 1, [1, 1])) == [] and "company_in_tenant" in broken(cmd.set_company_brands(state, TenantContext(2), 1, [1]))
    assert cmd.set_company_brands(state, CTX, 1, None)[0] is state and cmd.set_company_brands(state, CTX, 1, [])[0]["company_brands"].isEmpty()


def test_regions_contractors_and_deletes(state):
    new, found = cmd.create_region(state, 5, id=8, name="r", type="office")
    assert found.isEmpty() and [(r["tenant_id"], r["is_active"]) for r in new["operational_regions"].filter("id = 8").collect()] == [(1, True)]
    assert broken(cmd.create_contractor(state, CTX, 30, 3, "k", "permanent")) == []
    assert broken(cmd.remove(state, "organizations", 1)) == ["organizations.parent_id.restrict"]
    assert broken(cmd.remove(state, "locations", 6, TenantContext(2))) == ["locations.tenant"]
    assert "companies.business_entity_id.restrict" in broken(cmd.remove(state, "tenants", 1))
    assert cmd.remove(state, "locations", 6)[0]["operational_regions"].isEmpty()


def test_old_faults_block_no_command(state):
    two = state | {"organizations": state["organizations"].unionByName(cmd.row(state, "organizations", id=8, tenant_id=1, name="second root"))}
    assert broken(cmd.update_organization(two, CTX, 1, {"name": "new"})) == []
    assert broken(cmd.update_organization(two, CTX, 2, {"parent_id": None})) == ["single_root"]


def test_contractors_and_regions_change(state):
    assert broken(cmd.update_contractor(state, 1, "n", "permanent")) == [] and broken(cmd.update_contractor(state, 1, "n", "odd")) == ["contractors.contractor_type.in"]
    assert broken(cmd.create_region(state, 99, id=8, name="r", type="office")) == ["operational_regions.location_id.exists"]
    assert broken(cmd.update_region(state, CTX, 5, 7, {"name": "n"})) == ["region_of_location"] and broken(cmd.delete_region(state, TenantContext(2), 6, 7)) == ["locations.tenant"]


def test_links_change_with_their_brands(state):
    linked = cmd.link_entity(state, [(1, 1)], id=1, location_id=5, business_entity_id=10)[0]
    assert broken(cmd.update_link(linked, 5, 10, {"nace_code": "x"}, [(2, 1)])) == []
    assert broken(cmd.update_link(linked, 5, 10, {"operational_region_id": 7}, [(2, 9)])) == ["brand_of_company", "location_business_entity_brands.brand_id.exists", "region_of_location"]
    assert "link_exists" in broken(cmd.update_link(linked, 6, 10, {}, []))
    gone = cmd.unlink_entity(linked, 5, 10)[0]
    assert gone["location_business_entities"].isEmpty() and gone["location_business_entity_brands"].isEmpty()


def test_timestamps(state):
    new = cmd.create_location(state, CTX, id=9, name="l", tenant_id=2)[0]
    old = new["locations"].filter("id = 9").first()
    again = cmd.update_location(new, CTX, 9, {"name": "m", "tenant_id": 2})[0]["locations"].filter("id = 9").first()
    assert old["tenant_id"] == again["tenant_id"] == 1 and old["created_at"] == again["created_at"] and old["updated_at"] < again["updated_at"]


def test_onboarding_and_snapshots(state, spark, tmp_path):
    ids = {"tenant": 3, "organization": 40, "entity": 41, "company": 42, "link": 43, "location": 44}
    args = {"tenant": {"name": "C", "slug": "c"}, "organization": {"name": "o"}, "company": {"name": "c", "company_type": "corporate"}, "location": {"name": "l"}}
    good, bad = cmd.onboard(state, "group", ids, **args), cmd.onboard(state, "company", ids, **args)
    assert broken(bad) == ["group_company"] and not cmd.commit(bad, str(tmp_path / "bad"))
    assert cmd.commit(good, str(tmp_path / "good"))
    back = tables.restore(spark, str(tmp_path / "good"))
    assert all(sorted(map(tuple, back[n].collect()), key=repr) == sorted(map(tuple, good[0][n].collect()), key=repr) for n in TABLES)
    assert tables.scan(spark, str(tmp_path / "good"), "locations", CTX).count() == 2 and tables.scan(spark, str(tmp_path / "good"), "brands", TenantContext(2)).count() == 1


def test_unique_slug_and_null_aware_links(state, spark):
    assert broken(cmd.insert(state, "tenants", id=9, name="d", slug="a")) == ["tenants.slug.unique"]
    links = spark.createDataFrame([(1, 1, 1, None), (2, 1, 1, None), (3, 1, 1, 4), (4, 1, 1, 4)], "id long, l long, e long, r long")
    assert [r["entity_id"] for r in rules.duplicates(links, ["l", "e", "r"]).collect()] == [4]


def test_json_and_seeding(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "id long, name string")
    assert [r[0] for r in tables.to_documents(df).collect()] == ['{"data":{"id":1,"name":null}}']
    (tmp_path / "d.json").write_text('{"name": "n", "slug": "s", "evil": 1}\nbroken\n')
    assert sorted(map(tuple, tables.read_documents(spark, str(tmp_path / "d.json"), "name string, slug string", ["name"]).collect()), key=repr) == [("n",), (None,)]
    wanted = spark.createDataFrame([(2, "r"), (2, "r"), (1, "x")], "id long, name string")
    assert tables.first_or_create(df, wanted, ["id"]).count() == 2


def test_validation(spark):
    df = spark.createDataFrame([("ok-1", [1, 2], "a@b.co"), ("no no", [1, 1], "x"), (None, None, None)], "s string, a array<int>, m string")
    checks = {"required": C.required(F.col("s")), "dash": C.alpha_dash(F.col("s")), "distinct": C.distinct_items(F.col("a"), 1), "email": C.email(F.col("m"))}
    assert [r[0] for r in df.select(C.failures(checks)).collect()] == [[], ["dash", "distinct", "email"], ["required"]]
    one = spark.range(1).select(C.required_if(F.lit(None), F.lit(True)), C.different(F.lit(1), F.lit(1)), C.is_integer(F.lit("12x")), C.patched(F.lit(True), F.lit(None).cast("int"), F.lit(1)), C.logo_url(F.lit("/l.png"), "b"))
    assert tuple(one.first()) == (False, False, False, None, "b/storage/l.png")


def test_update_pivot_with_repeated_changes(spark):
    links = spark.createDataFrame([(1, 1, 1, "a"), (2, 1, 1, "b"), (3, 2, 1, "c")], "id int, l int, e int, v string")
    changes = spark.createDataFrame([(1, 1, "z"), (1, 1, "y")], "l int, e int, v string")
    assert sorted(map(tuple, reconcile.update_pivot(links, changes, ["l", "e"], ["v"]).collect())) == [(1, 1, 1, "y"), (2, 1, 1, "y"), (3, 2, 1, "c")]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 1), (2, 2)], "id long, tenant_id long").write.parquet(str(tmp_path / "in"))
    q = scoped.stream_table(spark, str(tmp_path / "in"), "id long, tenant_id long", CTX).writeStream.format("memory").queryName("scoped_rows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["id"] for r in spark.table("scoped_rows").collect()] == [1]
