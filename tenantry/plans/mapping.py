"""The domain's tables read from the star-schema test tables, so that queries can be held against SQL on the same data.

A region is a tenant, a nation a location and a group, customers are companies, suppliers contractors, part brands
brands; orders link them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES

#: Added to supplier keys, so that entity ids of companies and contractors differ.
SUPPLIER_BASE = 1_000_000_000
#: Lines of orders that a task joins.
LINES_A_TASK = 1_000_000


class Domain:
    """Lazy domain tables of one folder of test data; each is a plan, nothing but the number of lines is read before a query runs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def state(self, *names: str) -> dict[str, DataFrame]:
        """The state that commands take: the named tables with all declared columns (null where the test data lack them), the others empty."""

        def full(name: str) -> DataFrame:
            df = getattr(self, name)()
            return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name].struct])

        return {n: full(n) if n in names else self.spark.createDataFrame([], t.struct) for n, t in TABLES.items()}

    def tenants(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), F.lower("r_name").alias("slug"))

    def locations(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("tenant_id"), F.col("n_name").alias("name"))

    def organizations(self) -> DataFrame:
        """One holding for each tenant as root, the nations as groups below it."""
        roots = self.tenants().select((F.col("id") + 1000).alias("id"), F.col("id").alias("tenant_id"), F.lit(None).cast("long").alias("parent_id"), "name", F.lit("holding").alias("type"))
        groups = self.locations().select("id", "tenant_id", (F.col("tenant_id") + 1000).alias("parent_id"), "name", F.lit("group").alias("type"))
        return roots.unionByName(groups)

    def companies(self) -> DataFrame:
        kind = F.when(F.col("c_acctbal") < 0, "individual").otherwise("corporate")
        return self.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("business_entity_id"), F.col("c_name").alias("name"), kind.alias("company_type"))

    def contractors(self) -> DataFrame:
        kind = F.when(F.col("s_acctbal") < 0, "temporary").otherwise("permanent")
        return self.raw("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") + SUPPLIER_BASE).alias("business_entity_id"), kind.alias("contractor_type"))

    def business_entities(self) -> DataFrame:
        nation = self.locations().select(F.col("id").cast("int").alias("nation"), "tenant_id")
        c = self.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.lit("company").alias("type"), F.col("c_name").alias("name"))
        s = self.raw("supplier").select((F.col("s_suppkey") + SUPPLIER_BASE).alias("id"), F.col("s_nationkey").alias("nation"), F.lit("contractor").alias("type"), F.col("s_name").alias("name"))
        return c.unionByName(s).join(nation, "nation").select("id", "tenant_id", "type", "name")

    def brands(self) -> DataFrame:
        number = F.regexp_extract("name", "([0-9]+)", 1).cast("long")
        return self.raw("part").select(F.col("p_brand").alias("name")).distinct().select(number.alias("id"), (number % 5).alias("tenant_id"), "name")

    def _lines(self, column: str) -> DataFrame:
        """(o_custkey, column) of every line.

        Larger tables are dealt out by order to as many tasks as they have LINES_A_TASK, or more, so that what a task sorts and
        aggregates does not grow with them. Their number comes from the files' footers.
        """
        o, li = self.raw("orders").select("o_orderkey", "o_custkey"), self.raw("lineitem").select("l_orderkey", column)
        if (tasks := -(-li.count() // LINES_A_TASK)) > 1:
            tasks = max(tasks, self.spark.sparkContext.defaultParallelism)
            o, li = o.repartition(tasks, "o_orderkey"), li.repartition(tasks, "l_orderkey")
        return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", column)

    def company_brands(self) -> DataFrame:
        p = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("brand_id"))
        return self._lines("l_partkey").join(p, "l_partkey").select(F.col("o_custkey").alias("company_id"), "brand_id").distinct()

    def organization_companies(self) -> DataFrame:
        """Several groups for a company: one link for each order, to the group orderkey mod 25."""
        return self.raw("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 25).alias("organization_id"), F.col("o_custkey").alias("business_entity_id"))

    def location_business_entities(self) -> DataFrame:
        """Each customer at its nation, each supplier at the nations whose customers ordered from it; the region is null for every third."""
        c = self.raw("customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").cast("long").alias("location_id"), F.col("c_mktsegment").alias("nace_code"))
        own = c.select("location_id", F.col("entity").alias("business_entity_id"), "nace_code")
        far = self._lines("l_suppkey").join(c, F.col("o_custkey") == F.col("entity")).select("location_id", (F.col("l_suppkey") + SUPPLIER_BASE).alias("business_entity_id")).distinct()
        far = far.withColumn("nace_code", F.lit("SUPPLY"))
        both = own.unionByName(far)
        region = F.when(F.col("business_entity_id") % 3 != 0, F.col("location_id") * 10 + F.col("business_entity_id") % 5)
        link_id = F.col("business_entity_id") * 100 + F.col("location_id")
        return both.select(link_id.alias("id"), "location_id", "business_entity_id", region.alias("operational_region_id"), "nace_code")

    def operational_regions(self) -> DataFrame:
        """Five regions for each nation; region 4 of a nation is booked on the next location, as a fault to find."""
        five = self.locations().select("id", "tenant_id", F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("i"))
        at = F.when(F.col("i") == 4, F.col("id") + 1).otherwise(F.col("id"))
        return five.select((F.col("id") * 10 + F.col("i")).alias("id"), "tenant_id", at.alias("location_id"), F.concat_ws("-", F.lit("region"), "id", "i").alias("name"))

    def users(self) -> DataFrame:
        """One for each user of the events, with a made-up secret to hide."""
        ids = self.raw("events").select(F.col("user_id").cast("long").alias("id")).distinct()
        return ids.select("id", F.concat(F.lit("user-"), "id").alias("name"), F.sha2(F.col("id").cast("string"), 256).alias("password"), F.lit("t").alias("remember_token"))

    def user_roles(self) -> DataFrame:
        return self.raw("events").select(F.col("user_id").alias("model_id"), F.col("event_type").alias("role")).distinct()
