"""Exact order statistics: quantiles of many groups at once, and ranks, from counted ranges of the value.

Values are dealt to ranges by size (sixteen to each power of two), rows of each range are counted map-side, and the counts
tell which ranges hold the places that are asked for. A range of more than ROWS rows is cut into 256 equal parts,
counted again, and so on until it is small enough or has one value alone; equal values are counted together. So no
group, however large, is sorted in one task, and all rows are looked at twice as long as no range is too full.
Groups may be null; null values are left out of quantiles, NaN is larger than any number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

ROWS, PARTS, FEW = 1 << 20, 256, 1 << 16
SPLITTER = 134217729.0  # 2^27 + 1: halves the digits of a double


def _size(value: Column) -> Column:
    """The range of a number by its size; a larger number never has a lower one."""
    x = value.cast("double")
    size = 1 + F.floor((F.log2(F.abs(x)) + 1075) * 16)
    finite = F.when(x == 0, 0).otherwise(F.signum(x) * size)
    return F.when(F.isnan(x), 200_000).when(F.abs(x) == float("inf"), F.signum(x) * 100_000).otherwise(finite).cast("long")


def _part(value: Column, low: Column, high: Column) -> Column:
    """Which of PARTS equal parts of [low, high] a value lies in."""
    x, a, b = (c.cast("double") for c in (value, low, high))
    share = F.when(b > a, (x / 2 - a / 2) / (b / 2 - a / 2)).otherwise(0.0)
    return F.least(F.floor(share * PARTS), F.lit(PARTS - 1))


def _counts(rows: DataFrame, of: list[str]) -> DataFrame:
    """of, r, n, low, high of each range; written, as it is read for a decision and by the plan."""
    return stored(rows.groupBy(*of, "r").agg(F.sum("c").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "ranges")


def _holds(place: Column, before: Column, n: Column) -> Column:
    return (before <= place) & (place < before + n)


def _met(rows: DataFrame, ranges: DataFrame, few: bool) -> DataFrame:
    """rows of the ranges. Rows that were exploded look small to the optimizer, so it is told never to broadcast them."""
    return rows.join(F.broadcast(ranges) if few else ranges.hint("shuffle_hash"), ["g", "r"])


def between(low: Column, high: Column, part: Column) -> Column:
    """low * (1 - part) + high * part with the product of low rounded together with the sum, as a fused multiply-add
    does in DuckDB's quantile_cont. Comparisons with a quantile hang on its last digit."""
    a, b = low.cast("double"), 1 - part
    c, p = high.cast("double") * part, a * b
    halves = lambda x: (h := SPLITTER * x - (SPLITTER * x - x), x - h)
    (ah, al), (bh, bl) = halves(a), halves(b)
    lost = ((ah * bh - p) + ah * bl + al * bh) + al * bl  # what p lacks of the product
    s = p + c
    rest = (p - (s - (s - p))) + (c - (s - p))  # what s lacks of the sum
    plain = (F.abs(a) > 1e290) | (F.abs(high) > 1e290) | F.isnan(a) | F.isnan(high.cast("double"))
    return F.when(part == 0, a).when(plain, s).otherwise(s + (rest + lost))


def quantiles(rows: DataFrame, groups: str | list[str], value: str, names: dict[str, float], lower: bool = False, count: str | None = None, most: int = ROWS) -> DataFrame:
    """groups and, per name, the exact quantile p of the values: between the two nearest, or the lower of them.

    count: a column that says how often each value is to be counted, as of a histogram; it is positive.
    """
    groups = [groups] if isinstance(groups, str) else groups
    own = rows.where(F.col(value).isNotNull()).select(F.struct(*groups).alias("g"), F.col(value).alias("v"), (F.col(count) if count else F.lit(1)).cast("long").alias("c"))
    own = own.withColumn("r", F.array(_size(F.col("v"))))
    upto = Window.partitionBy("g").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = _counts(own, ["g"]).withColumns({"before": F.coalesce(F.sum("n").over(upto), F.lit(0)), "total": F.sum("n").over(Window.partitionBy("g"))})
    wanted = F.lit(False)
    for p in names.values():
        place = (F.col("total") - 1) * F.lit(p)
        wanted = wanted | _holds(F.floor(place), F.col("before"), F.col("n")) | (F.lit(not lower) & _holds(F.ceil(place), F.col("before"), F.col("n")))
    ranges = ranges.where(wanted)
    # How many ranges are wanted, and whether one of them is too full.
    known = lambda: ranges.agg(F.count("*") <= FEW, F.coalesce(F.max((F.col("n") > most) & (F.col("low") < F.col("high"))), F.lit(False))).first()
    few, full = known()
    while full:
        # Only rows of wanted ranges go on, in parts of them.
        own = _met(own, ranges.select("g", "r", "before", "total", "low", "high"), few)
        own = own.select("g", "v", "c", "before", "total", F.concat("r", F.array(_part(F.col("v"), F.col("low"), F.col("high")))).alias("r"), F.col("r").alias("of"))
        upto = Window.partitionBy("g", "of").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
        ranges = _counts(own, ["g", "of", "before", "total"]).withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(upto), F.lit(0))).where(wanted)
        own = own.select("g", "v", "c", "r")
        few, full = known()
    values = _met(own, ranges.select("g", "r", "before", "total"), few).groupBy("g", "r", "before", "total", "v").agg(F.sum("c").alias("n"))
    inside = Window.partitionBy("g", "r").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = values.withColumn("before", F.col("before") + F.sum("n").over(inside) - F.col("n"))
    out = []
    for name, p in names.items():
        place = (F.col("total") - 1) * F.lit(p)
        at = lambda k: F.max(F.when(_holds(k, F.col("before"), F.col("n")), F.col("v")))
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        out.append(F.struct(low.alias("low"), high.alias("high"), part.alias("part")).alias(name))
    of = lambda q: q["low"] if lower else between(q["low"], q["high"], q["part"])
    return values.groupBy("g").agg(*out).select("g.*", *(of(F.col(name)).alias(name) for name in names))


def medians(rows: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """groups, column, median: the median of each of several columns in each group, all from one selection."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("its_value")) for c in columns)))
    return quantiles(rows.select(*groups, each.alias("x")).select(*groups, "x.*"), [*groups, "column"], "its_value", {"median": 0.5})


def steps(rows: DataFrame, group: str, value: str, most: int = ROWS) -> DataFrame:
    """its_group, its_value, same, below, total: each value met in a group, how often, how many of the group are lower,
    and how many there are. Null is lower than any value."""
    met = rows.groupBy(F.struct(F.col(group).alias("k")).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("same"))
    met = met.withColumns({"c": F.lit(1).cast("long"), "r": F.array(F.coalesce(_size(F.col("v")), F.lit(-(1 << 40))))})
    while True:
        ranges = stored(met.groupBy("g", "r").agg(F.sum("c").alias("n"), F.sum("same").alias("rows"), F.min("v").alias("low"), F.max("v").alias("high")), "ranges")
        full = ranges.where((F.col("n") > most) & (F.col("low") < F.col("high")))
        if full.isEmpty():
            break
        # At most one range in ROWS values is too full.
        met = met.join(full.select("g", "r", "low", "high"), ["g", "r"], "left")
        met = met.withColumn("r", F.when(F.col("low").isNotNull(), F.concat("r", F.array(_part(F.col("v"), F.col("low"), F.col("high"))))).otherwise(F.col("r"))).drop("low", "high")
    upto = Window.partitionBy("g").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("g", "r", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy("g")).alias("total"))
    inside = Window.partitionBy("g", "r").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = _met(met, ranges, False).withColumn("below", F.col("before") + F.sum("same").over(inside) - F.col("same"))
    return found.select(F.col("g.k").alias("its_group"), F.col("v").alias("its_value"), "same", "below", "total")


def placed(rows: DataFrame, group: str, value: str, most: int = ROWS) -> DataFrame:
    """rows with how many of their group have a lower value (below), the same one (same), and any (total)."""
    met = F.col(group).eqNullSafe(F.col("its_group")) & F.col(value).eqNullSafe(F.col("its_value"))
    return rows.join(steps(rows, group, value, most), met).drop("its_group", "its_value")
