"""Quality classifier by Bradley-Terry ranking: scores learned from preference pairs, cut at a score quantile.

A document of label 1 is preferred to one of label 0. The score of a document is linear in its features, the
probability that a is preferred to b is the logistic function of the difference of their scores, so the weights
come from logistic loss on feature differences. The cut is the quantile of the training scores that separates the
labels best; scores are shifted so that the cut becomes 0.7 and squashed into 0..1.

Features are statistics of the text and hashed words and word pairs: each bucket counts its share of them, drawn to
nothing where a text has few. They are DataFrame expressions over whole texts, computed next to the scan; scoring
needs no shuffle. The weights are fitted on the driver from a bounded sample of labelled rows (``max_rows`` vectors).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table, whole_row, words

#: Score at the cut.
CUT = 0.7
#: Standard deviations beyond which a feature counts no more, in training and in scoring.
CLIP = 8.0
#: Buckets of hashed words and word pairs; a text's share of a bucket is its count / (all its words and pairs + PRIOR).
BUCKETS, PRIOR = 256, 50.0
NAMES = ("length", "symbols", "marks", "capitals", "digits", "adjacent", "distinct", "word_length", "lines")


def feature_columns(text: Column, w: Column, lines: Column) -> dict[str, Column]:
    """Name to expression, from a text and its words and lines; finite for every text, the empty one included."""
    n_chars = F.length(text).cast("double")

    def count(chars: str) -> Column:
        return n_chars - F.length(F.translate(text, chars, ""))

    n = F.size(w).cast("double")
    per_word = F.greatest(n, F.lit(1.0))
    same_as_next = F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: a == b), lambda same: same)
    return {
        "length": F.log1p(n),
        "symbols": F.sqrt(count("#*$%&|<>") / per_word),
        "marks": F.sqrt(count("!?;:~^=+_@\\/{}[]") / per_word),
        "capitals": F.sqrt(count(UPPER) / F.greatest(count(UPPER + LOWER), F.lit(1.0))),
        "digits": F.sqrt(count("0123456789") / F.greatest(n_chars, F.lit(1.0))),
        "adjacent": F.sqrt(F.size(same_as_next) / per_word),
        # distinct words against n^0.85, which natural texts of any length keep near a constant
        "distinct": F.log(F.greatest(F.size(F.array_distinct(w)).cast("double"), F.lit(1.0))) - 0.85 * F.log(per_word),
        "word_length": F.log1p(n_chars / per_word),
        "lines": F.sqrt((F.size(lines) - F.size(F.array_distinct(lines))) / F.greatest(F.size(lines).cast("double"), F.lit(1.0))),
    }


def gram_buckets(w: Column) -> Column:
    """The buckets of all words and of all pairs of neighbours, repeats included."""
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)))
    return F.concat(F.transform(w, lambda a: F.pmod(F.xxhash64(a), F.lit(BUCKETS))), pairs)


def gram_shares(buckets: pd.Series) -> pd.Series:
    """Each text's shares of all buckets, as the bytes of half-precision numbers."""
    return buckets.map(lambda b: (np.bincount(np.asarray(b, int), minlength=BUCKETS) / (len(b) + PRIOR)).astype(np.float16).tobytes())


def with_features(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """The columns of docs in the struct ``row``, the array column ``out`` of the features in the order of NAMES, and ``grams``, the buckets."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(whole_row(docs), F.col(text_col).alias("text")).withColumns({"words": words(text), "lines": F.filter(F.split(text, "\n", -1), lambda x: x != "")})  # once for all features
    f = feature_columns(text, F.col("words"), F.col("lines"))
    return split.select("row", F.array(*[f[name].cast("double") for name in NAMES]).alias(out), gram_buckets(F.col("words")).alias("grams"))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


@dataclass(frozen=True)
class Ranker:
    """score = squash(weights . clip((x - mean) / scale) + grams . shares + offset); x are features in the order of NAMES."""

    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    offset: float
    quantile: float
    grams: tuple[float, ...]

    def score(self, features: Column, buckets: Column) -> Column:
        z = [(F.get(features, i) - m) / s for i, (m, s) in enumerate(zip(self.mean, self.scale, strict=True))]
        terms = [F.least(F.greatest(v, F.lit(-CLIP)), F.lit(CLIP)) * w for v, w in zip(z, self.weights, strict=True)]
        raw = F.lit(self.offset)
        for t in terms:
            raw = raw + t
        weights = F.array(*[F.lit(g) for g in self.grams])
        raw = raw + F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.get(weights, b.cast("int"))) / (F.size(buckets) + PRIOR)
        return 1.0 / (1.0 + F.exp(-F.least(F.greatest(raw, F.lit(-500.0)), F.lit(500.0))))


def fit_pairs(x: np.ndarray, y: np.ndarray, shares: np.ndarray | None = None, pairs: int = 60_000, steps: int = 300, l2: float = 1e-3, l2_grams: float = 1e-2, seed: int = 11) -> Ranker:
    """Fit on feature rows x with labels y (1 is preferred to 0) and gram shares. Without both labels every score is the cut.

    Weights of grams pay a penalty of their own, so that words seen in few texts decide little.
    """
    d = x.shape[1]
    shares = np.zeros((len(x), BUCKETS), np.float32) if shares is None else shares
    if not (y == 1).any() or not (y == 0).any():
        return Ranker((0.0,) * d, (0.0,) * d, (1.0,) * d, float(np.log(CUT / (1 - CUT))), 0.0, (0.0,) * BUCKETS)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    spread = float(np.sqrt(shares.var(0).mean())) + 1e-4
    z = np.hstack([np.clip((x - mean) / scale, -CLIP, CLIP), shares / spread]).astype(np.float32)
    penalty = np.repeat([l2, l2_grams], [d, BUCKETS])
    rng = np.random.default_rng(seed)
    good, bad = rng.choice(np.flatnonzero(y == 1), pairs), rng.choice(np.flatnonzero(y == 0), pairs)
    w, m, v = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for t in range(1, steps + 1):  # Adam on the mean logistic loss of the pairs' differences
        raw = z @ w.astype(np.float32)
        p = 1 / (1 + np.exp(np.clip(raw[good] - raw[bad], -50, 50)))
        pull = np.bincount(good, p, len(z)) - np.bincount(bad, p, len(z))  # each row's share of the pairs not yet in order
        g = -(pull.astype(np.float32) @ z) / pairs + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    raw = z @ w
    # the quantile that separates the labels best; of equal ones the lowest, which rejects least
    order = np.argsort(raw, kind="stable")
    s, label = raw[order], y[order]
    rejected_bad, rejected_good = np.cumsum(label == 0) / (y == 0).sum(), np.cumsum(label == 1) / (y == 1).sum()
    gain = np.where(np.append(s[1:] > s[:-1], False), rejected_bad - rejected_good, -1.0)
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        cut, quantile = s[0], 0.0
    else:
        cut, quantile = (s[best] + s[best + 1]) / 2, (best + 1) / len(s)
    return Ranker(tuple(w[:d].tolist()), tuple(mean.tolist()), tuple(scale.tolist()), float(np.log(CUT / (1 - CUT)) - cut), quantile, tuple((w[d:] / spread).tolist()))


def fit_ranker(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Ranker:
    """Fit on at most ``max_rows`` labelled rows that are not held out, chosen by a hash of the id.

    Labels that are null or contradict each other for one id are left out; so are labels without a document.
    Documents that share an id count as many rows.
    """
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("__y"), F.max("quality").alias("__most"))
        .filter(F.col("__y") == F.col("__most"))
        .select(F.col("doc_id").alias("__id"), "__y")
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_rows)
    )
    # at most max_rows ids and labels of 12 bytes each
    sample = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    shares = F.pandas_udf(gram_shares, "binary")
    rows = with_features(sample, "__text", "__x").select("__x", shares("grams").alias("__shares"), "row.__y", "row.__doc", F.xxhash64("row.__text").alias("__h"))
    rows = rows.orderBy(F.xxhash64("__doc"), "__doc", "__h").limit(max_rows).select("__x", "__shares", "__y").toPandas()
    x = np.array(rows["__x"].tolist(), float).reshape(len(rows), len(NAMES))
    grams = np.frombuffer(b"".join(rows["__shares"]), np.float16).astype(np.float32).reshape(len(rows), BUCKETS)
    return fit_pairs(x, rows["__y"].to_numpy(int) if len(rows) else np.zeros(0, int), grams)


def score_documents(docs: DataFrame, ranker: Ranker, text_col: str = "text", threshold: float = CUT) -> DataFrame:
    """docs with ``score`` (0 to 1) and ``predicted`` (1 where score >= threshold); columns of these names are replaced.

    Null and empty texts are scored as texts without words. Repeated rows get equal scores. Other columns pass through
    whatever their names. Whole texts are read, however long.
    """
    scored = with_features(docs, text_col, "x").select("row", ranker.score(F.col("x"), F.col("grams")).alias("score"))
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    return scored.select(*kept, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranker = fit_ranker(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, ranker).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
