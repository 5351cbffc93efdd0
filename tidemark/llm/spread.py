"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HOT, LEAST_ROWS, SALTS = 1 << 16, 256, 64


def hot_keys(rows: DataFrame, key: str) -> list:
    """The keys of more than a 2^16th of all rows (and LEAST_ROWS): at most 2^16 of them, so they may be broadcast."""
    limit = max(LEAST_ROWS, rows.count() // MOST_HOT)
    return rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > limit).select(key).collect()


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """left join right on key. Rows of left with a hot key are dealt by a hash of `by` among SALTS tasks, and each of
    these gets a copy of the key's rows of right, which has few rows for a key."""
    found = hot_keys(left, key)
    if not found:
        return left.join(right, key, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(found, left.select(key).schema).withColumn("is_hot", F.lit(True)))
    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = left.join(hot, key, "left").withColumn("salt", salt).drop("is_hot")
    salts = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = right.join(hot, key, "left").withColumn("salt", F.explode(salts)).drop("is_hot")
    return dealt.join(copied, [key, "salt"], how).drop("salt")
