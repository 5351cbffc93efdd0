"""Range, as-of and containment joins on slices of time, and joins whose keys are held to a contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import SLICE, WIDTH, following, micros, sliced


def history_join(points: DataFrame, windows: DataFrame, key: str, start: str, end: str, at: str, bucket: int) -> DataFrame:
    """Pairs of a point (start, end) and the windows with start <= at <= end of the same key.

    A point is dealt to the buckets that its range touches, so the join is on (key, bucket) and never on key alone.
    """
    touched = F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket)))
    p, w = points.withColumn("bucket", touched), windows.withColumn("bucket", F.floor(F.col(at) / bucket))
    return p.join(w, [key, "bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("bucket")


def next_as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, width: int | None = None) -> DataFrame:
    """Each left row with the value of the first right row at or after it: one union, windows by slice, no range join."""
    both = left.withColumn("side", F.lit(0)).withColumn(value, F.lit(None).cast("double"))
    both = both.unionByName(right.select(key, at, value).withColumn("side", F.lit(1)), allowMissingColumns=True)
    found = following(sliced(both, key, micros(at), width), key, [at, "side"], "found", F.col(value))
    return found.withColumn(value, F.col("found")).where("side = 0").drop("side", "found", SLICE)


def contained(intervals: DataFrame, spans: DataFrame, key: str, start: str, end: str, width: int = WIDTH) -> DataFrame:
    """Intervals that lie inside one span of their key. Spans go to the slices they touch, intervals to that of their
    start, so the join is on (key, slice)."""
    touched = F.explode(F.sequence(F.floor(F.col("span_start") / width), F.floor(F.col("span_end") / width)))
    s = spans.select(F.col(key).alias("span_key"), "span_start", "span_end", touched.alias("span_slice"))
    met = (F.col(key) == F.col("span_key")) & (F.col(SLICE) == F.col("span_slice"))
    inside = met & (F.col("span_start") <= F.col(start)) & (F.col("span_end") >= F.col(end))
    return intervals.withColumn(SLICE, F.floor(F.col(start) / width)).join(s, inside, "left_semi").drop(SLICE)


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A row of counts: keys that repeat on either side, and keys that only one side has. All zero: the join is 1:1."""
    sides = left.groupBy(*keys).agg(F.count("*").alias("l")).withColumn("r", F.lit(0).cast("long")).unionByName(right.groupBy(*keys).agg(F.count("*").alias("r")).withColumn("l", F.lit(0).cast("long")))
    n = sides.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    of = lambda c, name: F.count_if(c).alias(name)
    return n.agg(of(F.col("l") > 1, "repeat_left"), of(F.col("r") > 1, "repeat_right"), of(F.col("r") == 0, "only_left"), of(F.col("l") == 0, "only_right"), of((F.col("l") > 0) & (F.col("r") > 0), "shared"))


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", complete: bool = False, suffixes: tuple[str, str] | None = None) -> DataFrame:
    """left join right after a check, which runs at once, that no key repeats on either side.

    complete: every key must be on both sides. suffixes: names for the columns that both sides have.
    """
    found = one_to_one(left, right, keys).first()
    if found["repeat_left"] or found["repeat_right"] or complete and (found["only_left"] or found["only_right"]):
        raise ValueError(f"not one to one on {keys}: {found.asDict()}")
    if suffixes:
        shared = [c for c in left.columns if c in right.columns and c not in keys]
        left, right = (side.withColumnsRenamed({c: c + s for c in shared}) for side, s in zip((left, right), suffixes, strict=True))
    return left.join(right, keys, how)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of table of their keys; a row whose key the table lacks fails the query when it is met."""
    found = rows.join(table.withColumn("its_hit", F.lit(True)), keys, "left")
    told = F.concat(F.lit("no entry for "), F.to_json(F.struct(*keys)))
    return found.where(F.when(F.col("its_hit"), F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))).drop("its_hit")
