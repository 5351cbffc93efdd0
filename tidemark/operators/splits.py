"""Chronological splits with an embargo, inner folds and circular shifts.

Places in time come from counts by slices (see sequences), so that one long key is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import SLICE, micros, placed


def chronological_split(df: DataFrame, key: str, embargo: int, train: float = 0.6, validation: float = 0.2, ts: str = "ts", tie: str = "event_id", width: int | None = None) -> DataFrame:
    """Adds split: train, validation, test by place in time, or excluded_embargo within `embargo` of a boundary.

    An embargo of 0 excludes nothing, not even rows at the very time of a boundary, which their places split.
    """
    n = F.col("n")
    i1 = F.least(F.greatest(F.floor(n * train), F.lit(1)), n - 2)
    i2 = F.least(F.greatest(F.floor(n * (train + validation)), i1 + 1), n - 1)
    df = placed(df, key, micros(ts), [ts, tie], width, {"b1": i1, "b2": i2}).withColumns({"t": micros(ts), "i1": i1, "i2": i2})
    part = F.when(F.col("i") < F.col("i1"), "train").when(F.col("i") < F.col("i2"), "validation").otherwise("test")
    out = (
        ((part == "train") & (F.col("t") >= F.col("b1") - embargo))
        | ((part == "validation") & ((F.col("t") < F.col("b1") + embargo) | (F.col("t") >= F.col("b2") - embargo)))
        | ((part == "test") & (F.col("t") < F.col("b2") + embargo))
    )
    return df.withColumn("split", F.when(out, "excluded_embargo").otherwise(part) if embargo else part)


def circular_shift(df: DataFrame, key: str, fraction: float, column: str, ts: str = "ts", tie: str = "event_id", width: int | None = None) -> DataFrame:
    """Adds shifted: column of the row max(1, round-half-even(n * fraction)) places on, around the end.

    Each row is dealt to its own place and its value to the place that it moves to; one shuffle brings the two together.
    """
    own = placed(df, key, micros(ts), [ts, tie], width).drop(SLICE)
    offset = F.greatest(F.lit(1), F.bround(F.col("n") * fraction).cast("int"))
    row, value = F.struct(*own.columns), F.struct(F.col(column).alias("v"))
    kind = {"row": own.select(row.alias("x")).schema["x"].dataType, "value": own.select(value.alias("x")).schema["x"].dataType}
    stays = F.struct(F.col("i").alias("place"), row.alias("row"), F.lit(None).cast(kind["value"]).alias("value"))
    moves = F.struct(F.pmod(F.col("i") - offset, F.col("n")).alias("place"), F.lit(None).cast(kind["row"]).alias("row"), value.alias("value"))
    dealt = own.select(F.struct(F.col(key).alias("k")).alias("of_key"), F.explode(F.array(stays, moves)).alias("d")).select("of_key", "d.*")
    met = dealt.groupBy("of_key", "place").agg(F.first("row", ignorenulls=True).alias("row"), F.first("value", ignorenulls=True).alias("value"))
    return met.select("row.*", F.col("value.v").alias("shifted"))


def inner_folds(df: DataFrame, key: str, folds: int, history: int, ts: str = "ts", tie: str = "event_id", width: int | None = None) -> DataFrame:
    """Each row once for every fold k of 1..folds, with role: assess, train or unused.

    A fold assesses rows [n k / (folds + 1), n (k + 1) / (folds + 1)) of its key; it trains on rows older than
    `history` microseconds before the first of these.
    """
    edge = lambda k: F.floor(F.col("n") * k / (folds + 1))
    names = [f"begin{k}" for k in range(1, folds + 1)]
    # A fold that assesses no row has no beginning.
    begins = {f"begin{k}": F.when(edge(k) < edge(k + 1), edge(k)) for k in range(1, folds + 1)}
    rows = placed(df, key, micros(ts), [ts, tie], width, begins).withColumn("t", micros(ts))
    rows = rows.withColumn("begins", F.array(*names)).drop(*names).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    assessed = (F.col("i") >= edge(F.col("fold"))) & (F.col("i") < edge(F.col("fold") + 1))
    role = F.when(assessed, "assess").when(F.col("t") < F.get("begins", F.col("fold") - 1) - history, "train").otherwise("unused")
    return rows.withColumn("role", role).drop("begins")
