"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; each of its documents then has the same expected number of copies,
target / source size. The whole part is taken outright. The fractional parts are rounded pairwise: two documents
exchange expected words, in a random direction whose odds keep every expectation, until one of the two holds
none or all of its words. A fold of this step over a bounded block leaves at most one open document; the open
documents of all blocks meet in blocks of the next level, and so on: a reduction tree whose depth is the
logarithm of the largest source. Only a source's last open document is drawn alone, so the words taken differ
from the target by less than one document.

Everything is DataFrame expressions; random numbers are hashes of ids, so reruns agree whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, uniform, whole_row, words

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, target): ``share`` of all words split by weight, no source above ``most`` times its size.

    What a source cannot take is shared again by weight among the others until none is above: the water level
    is found by sorting sources by bound / weight. That is in one task, over one row of some 50 bytes per source: a
    bound for up to tens of millions of sources, whatever the documents. Null sources are one
    source, the last in order. A source without words has target 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_bound = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    after = by_bound.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights)) + 1)
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("weight", weight)
        .withColumn("bound", F.col("source_size") * F.lit(float(most)))
        .withColumn("pool", F.sum("source_size").over(everywhere) * F.lit(float(share)))
        .withColumn("level", (F.col("pool") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("open", F.col("level") * F.col("weight") < F.col("bound"))
        # the level at the first source that stays under its bound holds for all later ones
        .withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("bound") / F.col("weight"), "source", "level"))).over(everywhere)["level"])
        .withColumn("target", F.when(F.col("level").isNull(), F.col("bound")).otherwise(F.least("bound", F.col("level") * F.col("weight"))))
        .select("source", "source_size", "n_docs", "target")
    )


def _fold(members: Column, seed: int) -> Column:
    """Pivotal steps along an array of struct(h, k1, k2, size, mass): struct(open: the member left, done: those decided, with up).

    Arrays hold a block of bounded size.
    """
    member = "struct<h:bigint,k1:bigint,k2:bigint,size:double,mass:double>"
    start = F.struct(F.lit(None).cast(member).alias("open"), F.array().cast(f"array<struct<k1:bigint,k2:bigint,up:boolean>>").alias("done"))

    def decided(m: Column, up: Column) -> Column:
        return F.array(F.struct(m["k1"].alias("k1"), m["k2"].alias("k2"), up.alias("up")))

    def with_mass(m: Column, mass: Column) -> Column:
        return F.struct(m["h"].alias("h"), m["k1"].alias("k1"), m["k2"].alias("k2"), m["size"].alias("size"), mass.alias("mass"))

    def state(open_: Column, done: Column) -> Column:
        return F.struct(open_.alias("open"), done.alias("done"))

    def step(acc: Column, m: Column) -> Column:
        a = acc["open"]
        give, take = F.least(a["mass"], m["size"] - m["mass"]), F.least(m["mass"], a["size"] - a["mass"])
        giving = uniform(a["h"], m["h"], a["k1"], m["k1"], seed=seed) * (give + take) < take
        empties, fills = a["mass"] <= m["size"] - m["mass"], m["mass"] <= a["size"] - a["mass"]
        return (
            F.when(a.isNull(), state(m, acc["done"]))
            .when(giving & empties, state(with_mass(m, m["mass"] + a["mass"]), F.concat(acc["done"], decided(a, F.lit(False)))))
            .when(giving, state(with_mass(a, a["mass"] - give), F.concat(acc["done"], decided(m, F.lit(True)))))
            .when(fills, state(with_mass(a, a["mass"] + m["mass"]), F.concat(acc["done"], decided(m, F.lit(False)))))
            .otherwise(state(with_mass(m, m["mass"] - take), F.concat(acc["done"], decided(a, F.lit(True)))))
        )

    return F.aggregate(members, start, step)


def mix_copies(sizes: DataFrame, targets: DataFrame, seed: int = 17, block: int = 64) -> DataFrame:
    """Copies for each unit of equal rows: (the columns of sizes, rows, copies), copies being the total of the unit's rows.

    ``sizes`` has (source, doc_id, size) and, where rows of one id are to be told apart, ``twin``. Rows equal in all of
    these are one unit, which takes the whole part of its expected copies and rounds one fraction; so a repeated row is
    no hot spot. Units of size 0 take the whole part.
    """
    keys = ["source", "doc_id", "size", *(c for c in sizes.columns if c == "twin")]
    units = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    goal = targets.select(F.col("source").alias("__source"), "source_size", "n_docs", "target")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) * F.col("rows")
    units = (
        units.join(goal, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("whole", F.floor(expected))
        .withColumn("mass", (expected - F.floor(expected)) * F.col("size"))
        .withColumn("k1", F.xxhash64(*keys))
        .withColumn("k2", F.xxhash64(F.lit(5), *keys))
        .withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source", *keys[2:]))
        .select(*keys, "rows", "whole", "mass", "k1", "k2", "h", F.ceil(F.col("n_docs") / block).alias("blocks"))
    )
    scratch = Scratch(sizes.sparkSession)
    units = scratch.write(units)
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    level = (
        units.filter((F.col("mass") > 0) & (F.col("mass") < F.col("size")))
        .select("source", F.pmod("h", "blocks").alias("at"), F.struct("h", "k1", "k2", F.col("size").cast("double").alias("size"), "mass").alias("m"))
    )
    done, left = None, -(-most // block)
    while True:
        folded = scratch.write(level.groupBy("source", "at").agg(_fold(F.sort_array(F.collect_list("m")), seed).alias("f")))
        rounds = folded.select(F.explode("f.done").alias("d")).select("d.*")
        done = rounds if done is None else done.unionByName(rounds)
        if left <= 1:
            break
        left = -(-left // block)
        level = folded.filter(F.col("f.open").isNotNull()).select("source", F.floor(F.col("at") / block).alias("at"), F.col("f.open").alias("m"))
    last = folded.filter(F.col("f.open").isNotNull()).select("f.open.*")
    done = done.unionByName(last.select("k1", "k2", (uniform(F.col("h"), seed=seed + 1) * F.col("size") < F.col("mass")).alias("up")))
    return units.join(done, ["k1", "k2"], "left").select(
        *keys, "rows", (F.col("whole") + F.coalesce(F.col("up"), F.lit(False)).cast("long")).alias("copies")
    )


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def mix(docs: DataFrame, seed: int = 17, part: int = 1000) -> DataFrame:
    """docs with each row repeated as often as the mix takes it (0, 1 or 2 times), with the same columns.

    Null texts have size 0 and null sources are one source. Rows equal in all columns share their copies: they are
    kept once, with the number of all their copies, and more than ``part`` copies are made in parts that are dealt
    over all tasks. Rows that only share source, id and size are rounded each for itself. Other columns pass through
    whatever their names. Whole texts are read, however long.
    """
    # the input's columns lie in one struct, so that none clashes with those made here
    sized = docs.select(whole_row(docs), "source", "doc_id", word_count(F.col("text")).alias("size"))
    content = F.to_json("row") if "map<" in docs.schema.simpleString() else F.col("row")  # maps have no hash
    sized = sized.withColumn("twin", F.struct(F.xxhash64(content).alias("a"), F.xxhash64(F.lit(seed), content).alias("b")))
    scratch = Scratch(docs.sparkSession)
    sizes = scratch.write(sized.select("source", "doc_id", "size", "twin"))
    taken = mix_copies(sizes, scratch.write(source_targets(sizes)), seed).filter(F.col("copies") > 0).select(F.col("twin").alias("t"), F.col("doc_id").alias("d"), F.col("size").alias("z"), F.col("source").alias("s"), "copies")
    once = sized.dropDuplicates(["source", "doc_id", "size", "twin"])
    joined = once.join(taken, F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z")) & (F.col("twin") == F.col("t")))
    few = joined.filter(F.col("copies") <= part).select("row", F.col("copies").alias("n"))
    parts = joined.filter(F.col("copies") > part).select("row", "twin", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / part))).alias("i"))
    many = parts.repartition("twin", "i").select("row", F.least(F.lit(part).cast("long"), F.col("copies") - F.col("i") * part).alias("n"))
    return few.unionByName(many).select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    sizes = scratch.write(table(spark, sf_dir, "documents").select("source", "doc_id", word_count(F.col("text")).alias("size")))
    targets = scratch.write(source_targets(sizes))
    units = mix_copies(sizes, targets)
    goal = targets.select(F.col("source").alias("__source"), "source_size", "target")
    out = units.join(goal, F.col("source").eqNullSafe(F.col("__source")))
    each, extra = F.floor(F.col("copies") / F.col("rows")), F.col("copies") % F.col("rows")
    counts = F.filter(F.array(F.struct((each + 1).alias("n"), extra.alias("rows")), F.struct(each.alias("n"), (F.col("rows") - extra).alias("rows"))), lambda x: x["rows"] > 0)
    return (
        out.withColumn("c", F.explode(counts))
        .withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c.rows"))))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("c.n")).alias("taken"))
    )
