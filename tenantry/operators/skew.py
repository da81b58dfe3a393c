"""Joins on keys of which a few hold many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows is dealt to several tasks; hot keys that are broadcast at most (16 bytes each).
MANY_ROWS, MOST_HOT, SALTS = 100_000, 1_000_000, 32


def lookup(df: DataFrame, side: DataFrame, key: str, how: str = "left", spread: str | None = None) -> DataFrame:
    """df joined with ``side`` on ``key``, where side has a few rows for each key at most.

    Keys with more than MANY_ROWS rows of df are found by partial counts: there are at most rows / MANY_ROWS of them.
    Their rows are dealt out by a salt, the hash of ``spread`` or of all columns, and side's rows for them are
    repeated for each salt. Without such keys it is a plain join.
    """
    hot = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter((F.col("__n") > MANY_ROWS) & F.col(key).isNotNull()).select(F.col(key).alias("__hot"))
    found = hot.limit(MOST_HOT + 1).count()
    if not 0 < found <= MOST_HOT:
        return df.join(side, key, how)
    keys = F.broadcast(hot)
    salt = F.pmod(F.xxhash64(spread) if spread else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS)).cast("int")
    left = df.join(keys, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.when(F.col("__hot").isNotNull(), salt).otherwise(F.lit(0))).drop("__hot")
    every = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = side.join(keys, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return left.join(right, [key, "__salt"], how).drop("__salt")
