"""Sequence windows: rows don't depend on slices, plans read their input twice at most, and no slice is too full."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sequences, splits
from tidemark.operators import timeseries as ts
from tidemark.plans import catalogue

SECOND = 1_000_000


def rows_of(spark, n=300, seed=4):
    rng = random.Random(seed)
    at = sorted(rng.randint(0, 4000) for _ in range(n))
    rows = [(e, rng.choice([1, 1, 1, 2, 3, None]), t if rng.random() > 0.02 else None, float(rng.randint(0, 9))) for e, t in enumerate(at)] + [(n, 9, 5, 1.0)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long, value double")
    return rows, df.select("event_id", "user_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "value")


def ordered(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        by.setdefault(r[1], []).append(r)
    return by


@pytest.mark.parametrize("width", [61 * SECOND, 700 * SECOND, 10**12])
def test_places_splits_and_shifts_by_hand(spark, width):
    rows, df = rows_of(spark)
    place = {r["event_id"]: (r["i"], r["n"]) for r in sequences.placed(df, "user_id", ts.micros("ts"), ["ts", "event_id"], width).collect()}
    shifted = {r["event_id"]: r["shifted"] for r in splits.circular_shift(df, "user_id", 0.25, "value", width=width).collect()}
    split = {r["event_id"]: (r["split"], r["b1"], r["b2"]) for r in splits.chronological_split(df, "user_id", 50 * SECOND, width=width).collect()}
    role = {(r["event_id"], r["fold"]): r["role"] for r in splits.inner_folds(df, "user_id", 3, 30 * SECOND, width=width).collect()}
    micro = lambda t: None if t is None else t * SECOND
    for own in ordered(rows).values():
        n = len(own)
        i1 = min(max(int(n * 0.6), 1), n - 2)
        i2 = min(max(int(n * (0.6 + 0.2)), i1 + 1), n - 1)
        t1, t2 = (micro(own[i][2]) if 0 <= i < n else None for i in (i1, i2))
        for i, (e, _, t, _) in enumerate(own):
            assert place[e] == (i, n)
            assert shifted[e] == own[(i + max(1, round(n * 0.25))) % n][3]
            part = "train" if i < i1 else "validation" if i < i2 else "test"
            if t is not None and t1 is not None and t2 is not None:
                t = micro(t)
                out = {"train": t >= t1 - 50 * SECOND, "validation": t < t1 + 50 * SECOND or t >= t2 - 50 * SECOND, "test": t < t2 + 50 * SECOND}[part]
                assert split[e] == ("excluded_embargo" if out else part, t1, t2)
            for k in (1, 2, 3):
                low, high = n * k // 4, n * (k + 1) // 4
                begin = micro(own[low][2]) if low < high else None
                want = "assess" if low <= i < high else "train" if begin is not None and own[i][2] is not None and micro(own[i][2]) < begin - 30 * SECOND else "unused"
                assert role[e, k] == want


def scans(df, column="event_id"):
    """How often a plan reads a table that has the column."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum("Relation [" in line and column + "#" in line for line in plan.splitlines())


@pytest.mark.parametrize("name", ["w01_lag_profile", "w02_spans", "w04_smooth_median3", "w07_tumbling", "w08_ten_statistics", "w10_shift_features", "w12_split", "w13_embargo", "w14_inner_folds", "w17_blocks_rms", "w05_eligible"])
def test_input_is_read_twice_at_most(spark, name):
    assert 1 <= scans(catalogue.queries()[name](spark, "/root/testdata/sf0.001")) <= 2


def test_slices_follow_the_rows(spark):
    """A day of one key at 64 Hz is dealt to slices of 2^20 rows at most, by the default; a burst only down to a second."""
    df = spark.range(64 * 86_400, numPartitions=8).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.timestamp_micros((F.col("id") * 15_625).cast("long")).cast("timestamp_ntz").alias("ts"))
    rows = ts.islands(df, "user_id", 31_250)
    sizes = Counter({r[sequences.SLICE]: r["count"] for r in rows.groupBy(sequences.SLICE).count().collect()})
    assert len(sizes) >= 6 and max(sizes.values()) <= sequences.ROWS and sizes.total() == 64 * 86_400
    assert rows.agg(F.max("island")).first()[0] == 0
    burst = df.withColumn("ts", F.timestamp_seconds(F.lit(7)).cast("timestamp_ntz")).limit(3000)
    assert sequences.width_of(burst, "user_id", ts.micros("ts"), rows=1000) == SECOND
    assert sequences.width_of(df.limit(0), "user_id", ts.micros("ts")) == sequences.WIDTH
