"""Measures of predictions and compositions as aggregates; nothing is collected."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """truth, predicted, n and share: counts of each pair met, and their part of the truth's row."""
    counts = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def balanced_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Mean recall over the classes that the truth holds."""
    recall = df.groupBy(truth).agg(F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("recall"))
    return recall.agg(F.avg("recall").alias("balanced_accuracy"))


def total_variation(df: DataFrame, group: str, kind: str) -> DataFrame:
    """group, distance: half the summed differences between the group's shares of kinds and the shares of all rows."""
    counts = df.groupBy(group, kind).agg(F.count("*").alias("n"))
    total = counts.groupBy(kind).agg(F.sum("n").alias("all_n"))
    total = total.select(kind, (F.col("all_n") / F.sum("all_n").over(Window.partitionBy(F.lit(1)))).alias("q"))  # a row for each kind
    shares = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(group))).join(total, kind)
    met = F.sum(F.abs(F.col("p") - F.col("q")))
    return shares.groupBy(group).agg(((met + 1 - F.sum("q")) / 2).alias("distance"))


def upper_tail(null: Column, observed: float) -> Column:
    """Empirical upper-tail p of an observed value among null draws."""
    return (1 + F.count_if(null >= observed)) / (1 + F.count(null))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that the parts alone decide, the same on every run and executor."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def stratified_folds(df: DataFrame, identity: str, stratum: str, folds: int) -> DataFrame:
    """Adds fold: each stratum dealt out evenly in an order given by digests, in 256 slices so that no task holds one."""
    digest = F.md5(F.col(identity).cast("string"))
    part = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int")
    w = Window.partitionBy(stratum, "part").orderBy("digest", identity)
    rows = df.withColumn("digest", digest).withColumn("part", part)
    return rows.withColumn("fold", (F.row_number().over(w) - 1 + F.col("part")) % folds).drop("digest", "part")


def bootstrap_means(df: DataFrame, identity: str, value: str, draws: int) -> DataFrame:
    """draw, mean: means of `value` where each row of `df` counts Poisson(1) times in a draw.

    The rows of a draw add up map-side, so the shuffle carries a sum and a count for each draw and task.
    """
    rows = df.where(F.col(value).isNotNull())
    return bootstrap_means_of(rows, identity, [value], draws).select("draw", F.col(value).alias("mean"))


def bootstrap_means_of(df: DataFrame, identity: str, values: list[str], draws: int) -> DataFrame:
    """draw and the means of several values, nulls left out, as bootstrap_means() gives for each: how often a row counts
    in a draw is worked out once for all of them."""
    rows = df.select(identity, *values).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    # A column of its own, as it is dear and compared many times.
    rows = rows.withColumn("its_u", uniform(F.col(identity), F.col("draw")) * math.e)
    times, reach = F.lit(6), 0.0
    steps = []
    for k in range(6):
        reach += 1 / math.factorial(k)
        steps.append((reach, k))
    for limit, k in reversed(steps):
        times = F.when(F.col("its_u") < limit, k).otherwise(times)
    rows = rows.withColumn("its_times", times)
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("its_times")), F.sum(F.when(F.col(c).isNotNull(), F.col("its_times"))))
    return rows.groupBy("draw").agg(*(mean(c).alias(c) for c in values))


def summary(df: DataFrame, value: str) -> DataFrame:
    """mean, sd (of a sample; 0 for one value), q025, q50, q975 of a column of few rows, such as a row per fold."""
    q = lambda p: F.round(F.percentile(value, p), 6)
    sd = F.when(F.count(value) > 1, F.stddev_samp(value)).when(F.count(value) == 1, 0.0)
    return df.agg(F.round(F.avg(value), 6).alias("mean"), F.round(sd, 6).alias("sd"), q(0.025).alias("q025"), q(0.5).alias("q50"), q(0.975).alias("q975"))


def class_scores(df: DataFrame, groups: list[str], truth: str, predicted: str, classes: list) -> DataFrame:
    """groups, class, support, prec, recall, f1 for every class of the list; what has no cases scores 0.

    Counts per (groups, truth, predicted) are made first; what follows has a row for each class and group.
    """
    counts = df.groupBy(*groups, truth, predicted).agg(F.count("*").alias("n"))
    each = counts.withColumn("class", F.explode(F.array(*map(F.lit, classes))))
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    y, p = F.col(truth).eqNullSafe(F.col("class")), F.col(predicted).eqNullSafe(F.col("class"))
    found = each.groupBy(*groups, "class").agg(of(y & p).alias("tp"), of(p).alias("pp"), of(y).alias("support"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return found.select(*groups, "class", "support", ratio(F.col("tp"), F.col("pp")).alias("prec"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("pp") + F.col("support")).alias("f1"))


def macro_f1(df: DataFrame, groups: list[str], truth: str, predicted: str, classes: list) -> DataFrame:
    """groups, macro_f1 over the classes of the list, whether they occur or not."""
    return class_scores(df, groups, truth, predicted, classes).groupBy(*groups).agg(F.avg("f1").alias("macro_f1"))


def places(df: DataFrame, keys: list[str | Column], parts: int = 64) -> DataFrame:
    """Adds place, from 1, in the order of the keys: rows are dealt into sorted ranges, numbered within each, and moved
    by the counts of the ranges before."""
    rows = df.select("*", *(k for k in keys if isinstance(k, Column))).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    numbered = rows.withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part").orderBy(*keys)
    counts = numbered.groupBy("part").agg(F.count("*").alias("rows"))
    base = counts.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return numbered.withColumn("inside", F.row_number().over(inside)).join(F.broadcast(base), "part").withColumn("place", F.col("inside") + F.col("base"))


def reserve(df: DataFrame, identity: str, stratum: str, fraction: float) -> DataFrame:
    """Adds reserved: the first ceil(fraction * n) rows of each stratum in an order given by digests.

    Rows are numbered in 256 slices of the digest and moved by the counts of the slices before.
    """
    digest = F.md5(F.col(identity).cast("string"))
    rows = df.withColumn("digest", digest).withColumn("part", F.substring(digest, 1, 2))
    counts = rows.groupBy(F.col(stratum).alias("its"), F.col("part").alias("slice")).agg(F.count("*").alias("its_rows"))
    own = Window.partitionBy("its")
    before = F.sum("its_rows").over(own.orderBy("slice")) - F.col("its_rows")
    base = counts.select("its", "slice", before.alias("its_before"), F.sum("its_rows").over(own).alias("its_all"))
    inside = F.row_number().over(Window.partitionBy(stratum, "part").orderBy("digest", identity))
    met = F.col(stratum).eqNullSafe(F.col("its")) & (F.col("part") == F.col("slice"))
    found = rows.withColumn("inside", inside).join(F.broadcast(base), met)
    return found.select(*df.columns, (F.col("inside") + F.col("its_before") <= F.ceil(F.lit(fraction) * F.col("its_all"))).alias("reserved"))
