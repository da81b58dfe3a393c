"""Quality rules: base statistics of a text and robust multivariate outliers per language and source.

The statistics of every text become a vector of transformed ratios. For each (lang, source), each language and all
rows a minimum covariance determinant estimate is sought over the distinct vectors, so that copies of a text count
once: from several starts, concentration steps take the half of the vectors nearest to the current centre and give
the next mean and covariance. After TRIAL steps only the start of a group's least determinant goes on, until its
determinant falls no more; of all starts and steps the least determinant wins. Covariances have RIDGE added, as statistics may be constant, so it is the regularised determinant that is
least. An estimate is scaled so that the median of its squared distances is that of a chi-square distribution. A
(lang, source) of n vectors has the weight n / (n + PRIOR) against its language, and that likewise against all rows:
no group is too small for an estimate and none switches. A document is an outlier if its squared Mahalanobis
distance is beyond the chi-square quantile at 1 - TAIL.

All of it is DataFrame expressions: the statistics are array functions within a row, the estimates are partial
aggregates per group, and distances come from a Cholesky factor spelled out as columns.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Scratch, table, uniform, words

DIMS = 4
#: The share of vectors in the concentrated half, the starts, about how many vectors a random start has, and the most steps.
SHARE, STARTS, SEEDS, STEPS = 0.5, 12, 12, 12
#: The steps that all starts take, and the starts of each group that then go on, as is usual for this estimate.
TRIAL, GO_ON = 2, 3
#: A determinant that falls by less than this share has stopped.
SETTLED = 1e-2
#: Vectors at which a group weighs as much as the wider one.
PRIOR = 40.0
#: The share of normal vectors beyond the bound, a squared distance of 59.9. It is tuned, as statistics of texts have far
#: heavier tails than normal vectors: of 3,302 labelled good documents that pass the base rule the largest distance
#: is 58.6 and the 0.99 quantile 29; of 301 bad ones the median is 939 and the 0.05 quantile 295.
TAIL = 3e-12
CHI2_MEDIAN = 3.3567  # of 4 degrees of freedom
#: Added to variances, so that a group whose rows agree in a statistic still has a covariance.
RIDGE = 0.02
#: Groups whose estimates are broadcast at most (some 400 bytes each for every start), and salts of the join beyond.
MOST_GROUPS, SALTS = 10_000, 16


def chi2_bound(tail: float) -> float:
    """The value that a chi-square variable of 4 degrees of freedom exceeds with probability ``tail``."""
    low, high = 0.0, 1500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if math.exp(-mid / 2) * (1 + mid / 2) > tail else (low, mid)
    return high


def text_statistics(docs: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """docs without the text, with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long).

    Null and empty texts have 0 of each. A window of ``window`` words counts as repeated if an equal one occurs
    elsewhere in the text, overlapping ones included; n_repeat_words is the number of words in such windows.
    Work per text is n log n in its words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = [c for c in docs.columns if c != text_col]
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    spaces = F.length(text) - F.length(F.translate(text, SPACES, ""))
    df = docs.select(
        *others,
        words(F.col(text_col)).alias("__words"),
        symbols.cast("long").alias("n_symbols"),
        (F.length(text) - spaces).cast("long").alias("word_chars"),
        lines.alias("__lines"),
    )
    df = df.select(
        *others, "n_symbols", "word_chars",
        F.size("__words").cast("long").alias("n_words"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__words"),
    )
    n = F.size("__words")
    starts = F.when(n >= window, F.sequence(F.lit(1), n - (window - 1))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("__windows", F.transform(starts, lambda i: F.xxhash64(F.slice("__words", i, window)))).drop("__words")
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    pairs = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__pairs", F.when(repeats, pairs)).drop("__windows")
    same = lambda i, j: F.get("__pairs", i)["h"] == F.get("__pairs", j)["h"]
    hit = F.filter("__pairs", lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    df = df.withColumn("__at", F.array_sort(F.transform(hit, lambda x: x["i"]))).drop("__pairs")
    covered = F.aggregate(
        "__at",
        F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return df.select(*others, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def statistic_vector() -> list[Column]:
    """The transformed statistics, each bounded or logarithmic, from the columns of text_statistics()."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.log((F.col("word_chars") + 1) / n),
        F.log((F.col("n_symbols") + 1) / (n + 20)),
        F.sqrt((F.col("n_repeat_words") + F.col("n_dup_lines")) / n),
    ]


X = [f"x{i}" for i in range(DIMS)]
MEANS = [f"m{i}" for i in range(DIMS)]
PAIRS = [(i, j) for j in range(DIMS) for i in range(j, DIMS)]
COVS = [f"c{i}{j}" for i, j in PAIRS]
FACTORS = [f"l{i}{j}" for i, j in PAIRS]


def _factored(estimates: DataFrame) -> DataFrame:
    """Estimates with the Cholesky factor of their covariance in l.. and the determinant, in ``det``."""
    for i, j in PAIRS:  # column by column
        value = functools.reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))
        estimates = estimates.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(RIDGE / 100))) if i == j else value / F.col(f"l{j}{j}"))
    return estimates.withColumn("det", functools.reduce(lambda a, i: a * F.col(f"l{i}{i}") * F.col(f"l{i}{i}"), range(DIMS), F.lit(1.0)))


def _squared_distance() -> Column:
    """Of x.. from the mean m.. under the factor l..: forward substitution, each term a column expression."""
    y: list[Column] = []
    for i in range(DIMS):
        y.append(functools.reduce(lambda a, k: a - F.col(f"l{i}{k}") * y[k], range(i), F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"l{i}{i}"))
    return functools.reduce(lambda a, b: a + b, [v * v for v in y])


def _with(rows: DataFrame, small: DataFrame, on: list[str], few: bool) -> DataFrame:
    """rows joined with one row of ``small`` each: broadcast if the groups are few, else by salted keys, as one may hold most rows."""
    if few:
        return rows.join(F.broadcast(small), on)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*X), F.lit(SALTS)).cast("int")).join(salted, [*on, "__salt"]).drop("__salt")


def mcd_estimates(points: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """(g, n, m.., c..) for every group g of ``points`` (g, x0..x3), and whether the groups are few enough to broadcast.

    The covariances have the ridge and are scaled to the chi-square median. Starts 0 and 1 are the halves nearest to the
    medians by sum of squares and by largest deviation, in units of the spreads; the others are some SEEDS vectors
    drawn by their hash.
    """
    middle = points.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(x, [0.1, 0.5, 0.9], 1000).alias(f"p{i}") for i, x in enumerate(X)])
    middle = scratch.write(middle)
    few = middle.count() <= MOST_GROUPS
    starts = _with(points, middle, ["g"], few).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))
    apart = [((F.col(x) - F.col(f"p{i}")[1]) / (F.col(f"p{i}")[2] - F.col(f"p{i}")[0] + RIDGE)) ** 2 for i, x in enumerate(X)]
    first = F.when(F.col("s") == 0, functools.reduce(lambda a, b: a + b, apart)).when(F.col("s") == 1, F.greatest(*apart))
    drawn = F.when(F.col("s") > 1, uniform(F.col("s"), *[F.col(x) for x in X], seed=5) * F.col("n") < SEEDS)
    placed = starts.select("g", "s", *X, first.alias("d"), drawn.alias("drawn"), F.lit(None).cast("double").alias("det"))
    found: list[DataFrame] = []
    while True:
        bounds = placed.groupBy("g", "s").agg(F.percentile_approx("d", SHARE, 1000).alias("bound"))
        picked = _with(placed, bounds, ["g", "s"], few)
        chosen = F.coalesce("drawn", F.col("d") <= F.col("bound"))
        at = [F.when(chosen, F.col(x)) for x in X]
        covs = [(F.covar_pop(at[i], at[j]) + (RIDGE if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
        estimates = picked.groupBy("g", "s").agg(F.max("det").alias("before"), *[F.avg(a).alias(m) for a, m in zip(at, MEANS, strict=True)], *covs)
        found.append(scratch.write(_factored(estimates.filter(F.col("m0").isNotNull()))))
        live = found[-1]
        if len(found) == TRIAL:
            ranked = F.slice(F.sort_array(F.collect_list(F.struct("det", "s"))), 1, GO_ON)  # of one row a start
            lead = live.groupBy("g").agg(ranked.alias("b")).select("g", F.explode("b.s").alias("s"))
            live = live.join(lead, ["g", "s"], "left_semi")
        live = live.filter(F.col("before").isNull() | (F.col("det") < F.col("before") * (1 - SETTLED)))
        if len(found) >= STEPS or live.isEmpty():
            break
        moved = _with(points, live.select("g", "s", *MEANS, *FACTORS, "det"), ["g"], few)
        placed = moved.select("g", "s", *X, _squared_distance().alias("d"), F.lit(None).cast("boolean").alias("drawn"), "det")
    every = functools.reduce(DataFrame.unionByName, found)
    best = scratch.write(every.groupBy("g").agg(F.min(F.struct("det", *MEANS, *COVS, *FACTORS)).alias("b")).select("g", "b.*"))
    mids = _with(points, best, ["g"], few).groupBy("g").agg(F.percentile_approx(_squared_distance(), 0.5, 1000).alias("mid"))
    # the half's covariance is smaller than the whole's, never larger
    scale = F.greatest(F.col("mid") / CHI2_MEDIAN, F.lit(1.0))
    out = best.join(mids, "g").join(middle.select("g", "n"), "g").select("g", "n", *MEANS, *[(F.col(c) * scale).alias(c) for c in COVS])
    written = scratch.write(out)
    scratch.drop(*found, middle, best)
    return written, few


def _shrunk(own: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """own's estimates drawn to those of ``wide`` (named by own's column ``key``), with the weight w = n / (n + PRIOR).

    The covariance has w^2 (1 - w) times the square of the means' difference added: a group of some ten vectors may lie
    elsewhere than the wider one, a few vectors are judged by the wider one.
    """
    w = F.col("n") / (F.col("n") + PRIOR)
    other = wide.select(F.col("g").alias(key), *[F.col(c).alias(f"__{c}") for c in (*MEANS, *COVS)])
    apart = [F.col(m) - F.col(f"__{m}") for m in MEANS]
    drawn = [(w * F.col(m) + (1 - w) * F.col(f"__{m}")).alias(m) for m in MEANS]
    drawn += [(w * F.col(c) + (1 - w) * F.col(f"__{c}") + w * w * (1 - w) * apart[i] * apart[j]).alias(c) for c, (i, j) in zip(COVS, PAIRS, strict=True)]
    return own.join(other, key).select(*[c for c in own.columns if c not in (*MEANS, *COVS)], *drawn)


def mcd_distances(stats: DataFrame, scratch: Scratch) -> DataFrame:
    """stats (with lang, source and x0..x3) plus ``distance``: squared Mahalanobis distance from the (lang, source)'s estimate.

    Null langs and sources are values of their own.
    """
    own, wider = F.xxhash64(F.lit(2), F.to_json(F.struct("lang", "source"))), F.xxhash64(F.lit(1), F.to_json(F.struct("lang")))
    keyed = stats.withColumns({"g": own, "g1": wider, "g0": F.lit(0).cast("long")})
    vectors = scratch.write(keyed.select("g", "g1", "g0", *X).distinct())
    points = scratch.write(vectors.select(F.explode(F.array("g", "g1", "g0")).alias("g"), *X).distinct())
    estimates, few = mcd_estimates(points, scratch)
    levels = vectors.select("g", "g1", "g0").distinct()
    wide = _shrunk(estimates.join(levels.select(F.col("g1").alias("g"), "g0").distinct(), "g"), estimates, "g0")
    own = scratch.write(_factored(_shrunk(estimates.join(levels.select("g", "g1"), "g"), wide, "g1")).select("g", *MEANS, *FACTORS))
    scratch.drop(vectors, points, estimates)
    return _with(keyed.drop("g1", "g0"), own, ["g"], few).withColumn("distance", _squared_distance()).drop("g", *MEANS, *FACTORS)


def quality_verdicts(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """doc_id, lang and source of docs, with the statistics, base_failed, distance and kept, one row for each of docs.

    Empty and null texts have no words and fail the base rule. Repeated rows each get the same verdict. Whole texts
    are read, however long; other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    stats = text_statistics(docs.select("doc_id", "lang", "source", "text"))
    stats = scratch.write(stats.select("*", *[c.alias(x) for c, x in zip(statistic_vector(), X, strict=True)]))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = mcd_distances(stats, scratch).drop(*X).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= chi2_bound(tail)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )
