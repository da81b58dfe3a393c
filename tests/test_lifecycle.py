"""Schema changes, commits, tenants' folders, ids, batches, collation, hierarchies, dumps and constraints."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tenantry.context import TenantContext
from tenantry.functions import collation
from tenantry.functions import columns as C
from tenantry.operators import hierarchy, reconcile, relations, rules, sequences, skew
from tenantry.plans import batch, mapping
from tenantry.plans import commands as cmd
from tenantry.plans.mapping import Domain
from tenantry.plans.queries import QUERIES
from tenantry.schema import TABLES, Reference, Table
from tenantry.sources import dump, evolution, layout, metadata, tables
from tenantry.sources.store import StaleVersion, Store

CTX = TenantContext(1)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# schema changes


def test_old_files_are_read_under_every_later_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    first = evolution.TableVersion.first("units", "id long, a int, b string, c float", {"b": ("x",)})
    evolution.write(spark.createDataFrame([(1, 10, "x", 1.5), (2, 20, "y", None)], "id long, a int, b string, c float"), first, path)
    second = first.rename("a", "n").widen("n", "long").rename("b", "a").drop("c").add("c", "string").allow("a", "y").rename_table("regions")
    evolution.write(spark.createDataFrame([(3, 1 << 40, "z", "new")], "id long, n long, a string, c string"), second, path)
    both = evolution.read(spark, second, path)
    assert rows_of(both.select("id", "n", "a", "c")) == [(1, 10, "x", None), (2, 20, "y", None), (3, 1 << 40, "z", "new")]
    assert [r["detail"] for r in evolution.outside_domains(both, second)[0].collect()] == ["z"] and second.name == "regions"
    third = second.drop("a").add("a", "long")
    assert rows_of(evolution.read(spark, third, path).select("id", "a")) == [(1, None), (2, None), (3, None)]


def test_filters_on_swapped_names_find_the_right_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    first = evolution.TableVersion.first("t", "a long, b long")
    evolution.write(spark.range(1000).select(F.col("id").alias("a"), (F.col("id") + 5000).alias("b")), first, path)
    swapped = evolution.read(spark, first.rename("a", "x").rename("b", "a").rename("x", "b"), path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,5)" not in plan(swapped.filter("a > 5"))
    renamed = evolution.read(spark, first.rename("b", "c"), path)
    assert "GreaterThan(a,5)" in plan(renamed.filter("a > 5")) and renamed.filter("c > 5500").count() == 499
    assert swapped.filter("a > 5500").count() == 499 and swapped.filter("b < 10").count() == 10 and swapped.filter("a < 10").isEmpty()


@pytest.mark.parametrize("change", [lambda v: v.rename("a", "b"), lambda v: v.rename("z", "y"), lambda v: v.drop("z"), lambda v: v.add("a", "int"), lambda v: v.widen("a", "int"), lambda v: v.widen("b", "long"), lambda v: v.allow("z", "1")])
def test_changes_that_cannot_be(spark, change):
    with pytest.raises((LookupError, ValueError)):
        change(evolution.TableVersion.first("t", "a long, b string"))


def test_rows_must_have_the_versions_columns(spark, tmp_path):
    with pytest.raises(ValueError):
        evolution.write(spark.range(1), evolution.TableVersion.first("t", "id long, b string"), str(tmp_path / "t"))


# commits


@pytest.fixture
def state(spark):
    s = {n: spark.createDataFrame([], TABLES[n].struct) for n in ("tenants", "locations", "organizations")}
    s["tenants"] = s["tenants"].unionByName(cmd.row(s, "tenants", {"id": 1, "name": "A", "slug": "a"}, {"id": 2, "name": "B", "slug": "b"}))
    s["locations"] = s["locations"].unionByName(cmd.row(s, "locations", {"id": 5, "tenant_id": 1, "name": "here"}, {"id": 6, "tenant_id": 2, "name": "there"}))
    return s


def test_a_commit_writes_changed_tables_only(spark, tmp_path, state):
    store = Store(spark, str(tmp_path / "s"))
    assert store.version() == 0 and store.state() == ({}, 0) and store.commit({}, state, 0) == 1
    old, at = store.state()
    new, found = cmd.update_location(old, CTX, 5, {"name": "moved"})
    assert store.commit(old, new, at, found) == 2
    one, two = store.paths(1), store.paths(2)
    assert one["tenants"] == two["tenants"] and one["locations"] != two["locations"]
    assert rows_of(store.state()[0]["locations"].select("id", "name")) == [(5, "moved"), (6, "there")]
    assert rows_of(store.state(1)[0]["locations"].select("id", "name")) == [(5, "here"), (6, "there")]
    store.vacuum()
    assert store.version() == 2 and not os.path.exists(one["locations"]) and os.path.exists(one["tenants"])
    assert store.state()[0]["tenants"].count() == 2


def test_a_failing_write_leaves_the_last_version(spark, tmp_path, state):
    store = Store(spark, str(tmp_path / "s"))
    store.commit({}, state, 0)
    old, at = store.state()
    boom = old["tenants"].withColumn("name", F.raise_error(F.lit("disk full")).cast("string"))
    renamed = cmd.update_location(old, CTX, 5, {"name": "moved"})[0]
    with pytest.raises(Exception, match="disk full"):
        store.commit(old, renamed | {"tenants": boom}, at)
    assert store.version() == 1 and rows_of(store.state()[0]["locations"].select("name")) == [("here",), ("there",)]
    assert len(os.listdir(tmp_path / "s" / "data")) == 1


def test_of_two_writers_one_is_late(spark, tmp_path, state):
    store, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    store.commit({}, state, 0)
    (a, at), (b, seen) = store.state(), other.state()
    store.commit(a, cmd.update_location(a, CTX, 5, {"name": "first"})[0], at)
    with pytest.raises(StaleVersion):
        other.commit(b, cmd.update_location(b, CTX, 5, {"name": "second"})[0], seen)
    other.version = lambda: seen  # both have passed the check: the pointer itself decides
    with pytest.raises(StaleVersion):
        other.commit(b, cmd.update_location(b, CTX, 5, {"name": "second"})[0], seen)
    assert rows_of(store.state()[0]["locations"].select("name")) == [("first",), ("there",)] and len(os.listdir(tmp_path / "s" / "data")) == 2


def test_violations_write_nothing(spark, tmp_path, state):
    store = Store(spark, str(tmp_path / "s"))
    store.commit({}, state, 0)
    old, at = store.state()
    assert store.commit(old, *reversed((at, cmd.update_location(old, CTX, 6, {"name": "x"})[0])), cmd.update_location(old, CTX, 6, {"name": "x"})[1]) is None
    assert store.version() == 1


def test_a_failing_snapshot_leaves_no_folder(spark, tmp_path, state):
    boom = state["tenants"].withColumn("name", F.raise_error(F.lit("disk full")).cast("string"))
    none = state["tenants"].select(F.lit("").alias("rule_id")).limit(0)
    with pytest.raises(Exception, match="disk full"):
        cmd.commit((state | {"tenants": boom}, none), str(tmp_path / "snap"))
    assert os.listdir(tmp_path) == []
    with pytest.raises(FileExistsError):
        cmd.commit((state, none), str(tmp_path))


# tenants' folders


@pytest.fixture
def laid_out(spark, tmp_path):
    rows = [(i, t, "company" if i % 2 else "contractor", f"n{i}", None, None) for i, t in enumerate([1, 1, 1, 2, 2, 3, None])]
    path = str(tmp_path / "entities")
    layout.write(spark.createDataFrame(rows, TABLES["business_entities"].struct), path)
    return path


def files(path, but=()):
    return {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet") and os.path.basename(d) not in but}


def test_bulk_changes_rewrite_their_tenants_only(spark, laid_out):
    before = files(laid_out, ["tenant_id=2"])
    assert layout.update_where(spark, laid_out, "business_entities", F.col("tenant_id") == 2, {"name": F.upper("name"), "id": 0, "tenant_id": 9}) == [2]
    assert files(laid_out, ["tenant_id=2"]) == before
    assert rows_of(layout.scan(spark, laid_out, "business_entities").filter("tenant_id = 2").select("id", "name")) == [(3, "N3"), (4, "N4")]
    assert layout.update_where(spark, laid_out, "business_entities", F.col("type") == "company", {"name": "x"}, CTX) == [1]
    assert rows_of(layout.scan(spark, laid_out, "business_entities").filter("name = 'x'").select("id")) == [(1,)]
    assert layout.update_where(spark, laid_out, "business_entities", F.lit(False), {"name": "x"}) == []


def test_bulk_deletes_empty_folders(spark, laid_out):
    before = files(laid_out, ["tenant_id=3", f"tenant_id={layout.NO_TENANT}"])
    assert layout.delete_where(spark, laid_out, "business_entities", F.col("id").isin(5, 6)) in ([3, None], [None, 3])
    assert files(laid_out) == before and not os.path.exists(f"{laid_out}/tenant_id=3")
    assert layout.delete_where(spark, laid_out, "business_entities", F.col("id").isNotNull(), TenantContext(2)) == [2]
    assert rows_of(layout.scan(spark, laid_out, "business_entities").select("id")) == [(0,), (1,), (2,)]


def test_a_context_prunes_folders(spark, laid_out):
    plan = layout.scan(spark, laid_out, "business_entities", CTX)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and layout.scan(spark, laid_out, "business_entities", CTX).inputFiles()
    assert all("tenant_id=1" in f or "tenant_id=" in f for f in layout.scan(spark, laid_out, "business_entities", CTX).inputFiles())


# generated ids


def test_ids_are_dense_and_equal_over_partitionings(spark):
    rows = spark.range(1000).select((F.col("id") % 37).alias("k"), F.concat(F.lit("n"), (F.col("id") % 100)).alias("v"), F.lit(1).alias("a.b"))
    want = None
    for n in (1, 7, 40):
        got = rows_of(sequences.allocate(rows.repartition(n), 50, ["k"]).select("id", "k", "v", "`a.b`"))
        assert sorted(r[0] for r in got) == list(range(51, 1051))
        assert want is None or got == want
        want = got
    by_id = sorted(want)
    assert [r[1:3] for r in by_id] == sorted(r[1:3] for r in by_id)


def test_insert_and_first_or_create(spark):
    current = spark.createDataFrame([(4, "a"), (9, None)], "id long, name string")
    assert rows_of(sequences.insert(current, spark.createDataFrame([("z",), ("b",)], "name string"), ["name"])) == [(10, "b"), (11, "z"), (4, "a"), (9, None)]
    wanted = spark.createDataFrame([("a",), (None,), ("c",), ("c",)], "name string")
    assert rows_of(sequences.first_or_create(current, wanted, ["name"])) == [(10, "c"), (4, "a"), (9, None)]
    assert sequences.last_id(current.limit(0)) == 0 and rows_of(sequences.insert(current.limit(0), wanted.limit(1), ["name"])) == [(1, "a")]
    assert sequences.allocate(wanted.limit(0), 3, ["name"]).isEmpty()


# batches


def requests_of(spark, *rows):
    return spark.createDataFrame(rows, "request long, tenant_id long, id long, changes map<string,string>")


def test_patches_fold_in_request_order(spark, state):
    asked = requests_of(
        spark, (2, 1, 5, {"name": "second"}), (1, 1, 5, {"name": "first"}), (3, None, 6, {"name": None}), (4, 2, 5, {"name": "foreign"}), (5, 1, 99, {"name": "lost"}), (6, 1, 5, {"nmae": "typo"}), (7, 1, 5, {}), (8, 1, 5, {"tenant_id": "2", "id": "7"})
    )
    new, found = batch.patch(state, "locations", asked, F.current_timestamp())
    assert [(r["id"], r["tenant_id"], r["name"], r["updated_at"] is not None) for r in new["locations"].orderBy("id").collect()] == [(5, 1, "second", True), (6, 2, None, True)]
    assert rows_of(found) == [(4, "locations.tenant", 5, "2"), (5, "locations.id.exists", 99, "99"), (6, "locations.columns", 5, "nmae"), (8, "locations.columns", 5, "id,tenant_id")]


def test_patches_of_keys_domains_and_references(spark, state):
    s = state | {"organizations": cmd.row(state, "organizations", *[{"id": i, "tenant_id": 1, "parent_id": 1 if i > 1 else None, "type": "group"} for i in (1, 2, 3)])}
    new, found = batch.patch(s, "organizations", requests_of(spark, (1, 1, 2, {"type": "odd"}), (2, 1, 2, {"parent_id": "2"}), (3, 1, 3, {"parent_id": "77"}), (4, 1, 3, {"parent_id": "x"}), (5, 1, 3, {"parent_id": "2", "type": "holding"})))
    assert rows_of(found.select("request", "rule_id")) == [(1, "organizations.type.in"), (2, "self_parent"), (3, "organizations.parent_id.exists"), (4, "organizations.parent_id.type")]
    assert rows_of(new["organizations"].select("id", "parent_id", "type")) == [(1, None, "group"), (2, 1, "group"), (3, 2, "holding")]


def test_a_taken_key_falls_to_the_earliest(spark, state):
    many = state | {"tenants": cmd.row(state, "tenants", *[{"id": i, "name": "n", "slug": s} for i, s in enumerate("abcd", 1)])}
    asked = requests_of(spark, (5, None, 1, {"slug": "New"}), (2, None, 2, {"slug": "NEW "}), (7, None, 3, {"slug": "D"}), (8, None, 3, {"name": "kept"}))
    new, found = batch.patch(many, "tenants", asked)
    assert rows_of(found.select("request", "rule_id")) == [(5, "tenants.slug.unique"), (7, "tenants.slug.unique")]
    assert rows_of(new["tenants"].select("id", "name", "slug")) == [(1, "n", "a"), (2, "n", "NEW "), (3, "kept", "c"), (4, "n", "d")]


def test_ten_thousand_patches_and_a_hot_row(spark, state, monkeypatch):
    monkeypatch.setattr(skew, "MANY_ROWS", 1000)
    rows = cmd.row(state, "locations", *[{"id": i, "tenant_id": 1, "name": "old"} for i in range(50)])
    asked = spark.range(10_000).select(F.col("id").alias("request"), F.lit(1).cast("long").alias("tenant_id"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 60).alias("id"), F.create_map(F.lit("name"), F.col("id").cast("string")).alias("changes"))
    new, found = batch.patch(state | {"locations": rows}, "locations", asked)
    want = {i: "old" for i in range(50)}
    for r in range(10_000):
        at = 7 if r % 2 == 0 else r % 60
        if at in want:
            want[at] = str(r)
    assert {r["id"]: r["name"] for r in new["locations"].collect()} == want
    assert found.count() == sum(1 for r in range(10_000) if r % 2 and r % 60 >= 50)


def test_an_empty_batch_changes_nothing(spark, state):
    new, found = batch.patch(state, "locations", requests_of(spark, (1, 1, 5, {})).limit(0))
    assert found.isEmpty() and rows_of(new["locations"]) == rows_of(state["locations"])


# collation


def test_slugs_collide_whatever_case_accents_and_trailing_spaces(spark, state):
    for slug in ("A", "á", "a "):
        assert [r["rule_id"] for r in cmd.insert(state, "tenants", id=9, name="d", slug=slug)[1].collect()] == ["tenants.slug.unique"]
    assert cmd.insert(state, "tenants", id=9, name="d", slug="ab")[1].isEmpty()


def test_lists_are_in_the_order_of_names(spark):
    df = spark.createDataFrame([(1, "Zoo"), (2, "álpha"), (3, "Beta"), (4, "alphb"), (5, "ALPHA"), (6, None)], "id long, name string")
    assert [r["id"] for r in collation.by_name(df).collect()] == [6, 2, 5, 4, 3, 1]
    both = df.select(collation.collated(F.col("name")).alias("n")).groupBy("n").count().filter("count = 2").select(collation.plain(F.col("n")).alias("n"))
    assert both.count() == 1


# hierarchies


def test_a_chain_of_ten_thousand_and_a_cycle_at_its_end(spark):
    chain = [(i, i - 1 if i else None) for i in range(10_000)]
    cycle = [(20_000, 20_002), (20_001, 20_000), (20_002, 20_001), *[(30_000 + i, 20_000 if not i else 30_000 + i - 1) for i in range(100)], (40_000, 40_000), (50_000, 49_999)]
    rows = chain + cycle
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 1)], "id long, parent_id long")
    got = {r["id"]: (r["root"], r["depth"]) for r in hierarchy.resolve(df).collect()}
    assert len(got) == len(rows) and all(got[i] == (0, i) for i in range(10_000))
    assert all(got[i] == (None, None) for i, _ in cycle if i != 50_000) and got[50_000] == (50_000, 0)
    assert rules.endless_parents(df).count() == 104


def test_many_rows_below_one(spark, monkeypatch):
    monkeypatch.setattr(skew, "MANY_ROWS", 50)
    df = spark.range(1, 2000).select("id", F.when(F.col("id") == 1, None).when(F.col("id") < 5, F.col("id") - 1).otherwise(4).alias("parent_id"))
    got = hierarchy.resolve(df.unionByName(df.limit(10)))
    assert got.filter("id > 4").agg(F.min("depth"), F.max("depth"), F.count("root")).first() == (4, 4, 1995) and got.count() == 1999
    assert hierarchy.resolve(df.limit(0)).isEmpty()


# dumps


def test_dumps_split_at_odd_offsets(spark, tmp_path):
    rng = random.Random(2)
    texts = ["it's", 'a "b"', "back\\slash", "\\n is two signs", "line\nfeed", "(1,2),\n(3", "x;\ny", "", None, "NULL", "tab\tcr\r", "\\'", "日本é", "''", "zero\0", "w" * 50_000, "'" * 3000 + "\\" * 3000]
    rows = [(i, rng.choice([1, 2, None]), rng.choice(texts), rng.choice([True, False, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, tenant_id long, name string, is_active boolean")
    path = str(tmp_path / "dump")
    dump.write_dump(df.select("name", "id", "is_active", "tenant_id").repartition(3), path, "things", rows=9)
    dump.write_dump(spark.range(5).select("id"), path, "others")
    want = sorted(rows, key=repr)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("134217728b", "1013b", "77777b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            assert rows_of(dump.read_dump(spark, path, "things", df.schema)) == want
            assert dump.read_dump(spark, path, "others", spark.range(1).schema).count() == 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_dumps_of_other_tools(spark, tmp_path):
    (tmp_path / "d.sql").write_text(
        "-- a dump\n/*!40101 SET NAMES utf8mb4 */;\nDROP TABLE IF EXISTS `locations`;\n/*!40101 SET x = 1 */;\nCREATE TABLE `locations` (\n  `id` bigint(20) unsigned NOT NULL AUTO_INCREMENT,\n  `name` varchar(255) NOT NULL,\n"
        "  `tenant_id` bigint(20) unsigned NOT NULL,\n  `created_at` timestamp NULL DEFAULT NULL,\n  PRIMARY KEY (`id`)\n) ENGINE=InnoDB;\n--\n-- Dumping data\n--\n\nLOCK TABLES `locations` WRITE;\n"
        "INSERT INTO `locations` VALUES\n(1,'a, (b)',3,'2026-08-19 12:04:50'),\n(2,'c',NULL,NULL);\nINSERT INTO `locations` (`tenant_id`, `id`) VALUES (4,3),(5,4);\nINSERT INTO `locations_old` VALUES (9,'no',1,NULL);\nUNLOCK TABLES;\n"
        "CREATE TABLE `empty` (\n  `id` bigint\n);\n"
    )
    got = dump.read_dump(spark, str(tmp_path / "d.sql"), "locations")
    assert rows_of(got.select("id", "tenant_id", "name", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), "updated_at")) == [(1, 3, "a, (b)", "2026-08-19 12:04:50", None), (2, None, "c", None, None), (3, 4, None, None, None), (4, 5, None, None, None)]
    assert dump.read_dump(spark, str(tmp_path / "d.sql"), "empty", spark.range(1).schema).isEmpty()
    with pytest.raises(LookupError):
        dump.read_dump(spark, str(tmp_path / "d.sql"), "nowhere", spark.range(1).schema)


# constraints


def test_constraints_travel_with_files(spark, tmp_path, state):
    for n in ("organizations", "tenants"):
        metadata.annotated(state[n], n).write.parquet(str(tmp_path / n))
    read = {n: spark.read.parquet(str(tmp_path / n)) for n in ("organizations", "tenants")}
    assert rows_of(metadata.constraints(*read.values())) == rows_of(metadata.constraints(*[metadata.annotated(state[n], n) for n in read]))
    assert ("reference", "organizations", "parent_id", "organizations", "id", "restrict") in rows_of(metadata.constraints(*read.values())) and ("unique", "tenants", "slug", None, None, "slug") in rows_of(metadata.constraints(*read.values()))
    assert ("tenants", "slug", "string", 2) in rows_of(metadata.columns(read)) and rows_of(metadata.constraints(state["tenants"])) == []
    own = metadata.annotated(spark.range(1).withColumn("p", F.lit(1)), "mine", Table("id long, p int", references=(Reference("p", "other"),)))
    assert rows_of(metadata.constraints(own)) == [("key", "mine", "id", None, None, "id"), ("reference", "mine", "p", "other", "id", "cascade")]


def test_discovery_is_exact(spark):
    parent = spark.range(3000).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 2999).alias("near"))
    child = spark.range(5000).select(F.col("id").alias("child_id"), F.when(F.col("id") % 7 != 0, F.col("id") % 3000).alias("parent_id"), F.when(F.col("id") == 17, 3000).otherwise(F.col("id") % 3000).alias("almost"), F.lit(None).cast("long").alias("nothing"), F.lit(1.5).alias("odd"))
    got = rows_of(metadata.discover({"parent": parent, "child": child, "empty": parent.limit(0)}))
    keys = [r[1:3] for r in got if r[0] == "key"]
    assert sorted(keys) == [("child", "child_id"), ("parent", "id"), ("parent", "name")]
    assert [r[1:] for r in got if r[0] == "reference"] == [("child", "parent_id", "parent", "id", "named"), ("parent", "id", "child", "child_id", "named"), ("parent", "near", "child", "child_id", "values")]


def test_discovery_joins_nothing(spark, monkeypatch):
    """Each value is aggregated once; joins for several candidates are sorts that add up in one task."""
    parent = spark.range(2000)
    child = spark.range(1990).select(*[((F.col("id") + i) % 1990).alias(f"c{i}") for i in range(5)])
    monkeypatch.setattr(type(parent), "join", None)
    got = rows_of(metadata.discover({"parent": parent, "child": child.unionByName(child)}))
    assert got == [("key", "parent", "id", None, None, None), *[("reference", "child", f"c{i}", "parent", "id", "values") for i in range(5)]]


def test_discovery_of_more_columns_than_one_number_has_bits(spark):
    n = metadata.BITS + 4
    wide = spark.range(40).select(*[(F.col("id") + int(i == n - 1)).alias(f"c{i}") for i in range(n)])
    got = rows_of(metadata.discover({"parent": spark.range(40), "wide": wide}))
    assert {r[1:3] for r in got if r[0] == "key"} == {("parent", "id"), *[("wide", f"c{i}") for i in range(n)]}
    assert {(r[1], r[2], r[4]) for r in got if r[0] == "reference"} == {x for i in range(n - 1) for x in (("wide", f"c{i}", "id"), ("parent", "id", f"c{i}"))}


# states that are derived once


def test_brand_is_created_over_links_that_are_derived_once(spark, sf_dir):
    """What the command gives reads the written links, not the lines they come from, once for each of its rules."""
    assert not [f for f in QUERIES["create_brand"](spark, sf_dir).inputFiles() if "lineitem" in f]


def test_lines_are_dealt_out_by_their_number(spark, sf_dir, monkeypatch):
    whole = Domain(spark, sf_dir)
    brands, links = rows_of(whole.company_brands()), rows_of(whole.location_business_entities())
    monkeypatch.setattr(mapping, "LINES_A_TASK", 100)
    assert whole._lines("l_partkey").count() == whole.raw("lineitem").count()
    assert "hashpartitioning(l_orderkey" in whole.company_brands()._jdf.queryExecution().executedPlan().toString()
    assert rows_of(whole.company_brands()) == brands and rows_of(whole.location_business_entities()) == links


def test_sync_of_rows_that_repeat_or_lack_a_key(spark):
    rng = random.Random(5)
    for owners in (None, [1, 4, None]):
        some = lambda n: [(rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2, 3, 4])) for _ in range(n)]
        now, want = [(*r, i) for i, r in enumerate(some(40))], some(8)
        touched = {o for o in (owners or [w[0] for w in want]) if o}
        pairs = {w for w in want if None not in w and w[0] in touched}
        stay = [r for r in now if r[0] not in touched or r[:2] in pairs]
        new = {w for w in want if w[0] in touched and w not in {r[:2] for r in now if None not in r}}
        named = spark.createDataFrame([(o,) for o in owners], "o int") if owners else None
        got = reconcile.sync(spark.createDataFrame(now, "o int, i int, a int"), spark.createDataFrame(want, "o int, i int"), "o", "i", named)
        assert rows_of(got) == sorted([*stay, *[(*w, None) for w in new]], key=repr)


# the rest


def test_small_things(spark, tmp_path):
    with pytest.raises(LookupError):
        relations.first_or_fail(spark.range(0), "id")
    assert relations.first_or_fail(spark.range(3), "id").first()["id"] == 0
    one = spark.createDataFrame([("true", 1536, "x"), ("0", None, None), ("maybe", 5, "")], "b string, n long, t string")
    assert [tuple(r) for r in one.select(C.is_boolean(F.col("b")), C.size_kb(F.col("n"))).collect()] == [(True, "1.50"), (True, None), (False, "0.00")]
    assert tables.has_columns(one, "b", "n") and not tables.has_columns(one, "z")
    assert [r["t"] for r in one.withColumn("t", C.logo_url(F.col("t"), "u")).collect()] == ["u/storage/x", None, None]


def test_tables_of_a_database(spark):
    """Derby, which ships with Spark, stands for any database: whole, in parts, and within a context."""
    url, driver = "jdbc:derby:memory:tenantry;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("tenant_id"), F.concat(F.lit("n"), "id").alias("name"))
    rows.write.format("jdbc").options(url=url, driver=driver, dbtable="locations").mode("overwrite").save()
    whole = tables.jdbc(spark, url, "locations", driver=driver)
    parts = tables.jdbc(spark, url, "locations", CTX, ("id", 0, 100, 4), driver=driver)
    assert rows_of(whole) == rows_of(rows) and rows_of(parts) == rows_of(rows.filter("tenant_id = 1")) and parts.rdd.getNumPartitions() == 4
    assert "PushedFilters" in parts._jdf.queryExecution().executedPlan().toString()


def test_tenants_change_with_their_logos(spark, state):
    with_logo = state | {"tenants": cmd.row(state, "tenants", {"id": 1, "slug": "a", "logo_path": "l/1"}, {"id": 2, "slug": "b", "logo_path": "l/2"}, {"id": 3, "slug": "c"})}
    new, found = cmd.update_tenant(with_logo, 1, {"logo_path": "l/9", "slug": "a"})
    assert found.isEmpty() and rows_of(cmd.replaced_logos(with_logo, new)) == [(1, "l/1")]
    assert [r["rule_id"] for r in cmd.update_tenant(with_logo, 1, {"slug": "no no"})[1].collect()] == ["tenants.slug.alpha_dash"]
    assert [r["rule_id"] for r in cmd.update_tenant(with_logo, 9, {"slug": "x"})[1].collect()] == ["tenants.id.exists"]
    gone, _ = cmd.delete_tenant(with_logo, 2)
    assert rows_of(cmd.replaced_logos(with_logo, gone)) == [(2, "l/2")] and rows_of(gone["locations"].select("id")) == [(5,)]
    made, found = cmd.create_tenant(with_logo, id=4, name="d", slug="d")
    assert found.isEmpty() and made["tenants"].filter("id = 4").first()["status"]
