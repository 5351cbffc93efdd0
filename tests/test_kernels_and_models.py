"""Kernels, models and contracts that SQL can't express, against independent implementations on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, joins, models, sequences, signals
from tidemark.operators import timeseries as ts

RNG = np.random.default_rng(7)
T64 = np.arange(64) / 64


def column(spark, rows):
    return spark.createDataFrame([(i, None if r is None else [float(v) for v in r]) for i, r in enumerate(rows)], "i long, x array<double>")


def one(df):
    return [r.f for r in df.orderBy("i").collect()]


def slow_peaks(x, apart, rise):
    """Peaks by their definition, one at a time."""
    at = []
    for i in range(1, len(x) - 1):
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            at.append((i + j) // 2)
    kept = []
    for p in sorted(at, key=lambda p: (-x[p], -p)):
        if all(abs(p - q) >= apart for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        lo = p
        while lo > 0 and x[lo - 1] <= x[p]:
            lo -= 1
        hi = p
        while hi + 1 < len(x) and x[hi + 1] <= x[p]:
            hi += 1
        rises = x[p] - max(min(x[lo : p + 1]), min(x[p : hi + 1]))
        if rises >= rise:
            out.append((p, rises))
    return out


def test_peaks_by_definition():
    for _ in range(200):
        x = RNG.integers(0, 9, RNG.integers(3, 40)).astype(float)
        apart, rise = int(RNG.integers(1, 6)), float(RNG.integers(0, 4))
        at, prominence = signals.peaks_of(x, apart, rise)
        assert list(zip(at.tolist(), prominence.tolist(), strict=True)) == slow_peaks(x.tolist(), apart, rise)


def test_channel_features(spark):
    t = np.arange(2000) / 200
    rows = [np.sin(2 * np.pi * 1.2 * t) + 2, np.full(2000, 3.0), RNG.normal(size=2000), None, []]
    got = one(column(spark, rows).select("i", signals.channel_features("x", 200.0).alias("f")))
    sine, flat, noise = got[:3]
    assert math.isclose(sine["mean"], 2, abs_tol=0.01) and math.isclose(sine["dominant_hz"], 1.2, abs_tol=0.11) and sine["band_ratio"] > 0.9
    assert math.isclose(sine["bpm"], 72, rel_tol=0.02) and math.isclose(sine["interval_mean"], 1 / 1.2, rel_tol=0.02)
    rises = [r for _, r in slow_peaks((rows[0] - rows[0].mean()).tolist(), 50, 0.1 * rows[0].std())]
    assert math.isclose(sine["prominence_mean"], np.mean(rises)) and math.isclose(sine["prominence_std"], np.std(rises), abs_tol=1e-9)
    assert all(v == 0 for k, v in flat.asDict().items() if k not in ("mean", "median", "minimum", "maximum"))
    assert all(math.isfinite(v) for r in got for v in r.asDict().values())
    assert math.isclose(noise["std"], rows[2].std()) and math.isclose(noise["iqr"], np.subtract(*np.quantile(rows[2], [0.75, 0.25])))
    n, z = 2000, (rows[2] - rows[2].mean()) / rows[2].std()
    assert math.isclose(noise["skew"], (z**3).mean() * math.sqrt(n * (n - 1)) / (n - 2), abs_tol=1e-9)
    assert math.isclose(noise["kurtosis"], (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * ((z**4).mean() - 3) + 6), abs_tol=1e-9)


def test_band_needs_samples_and_power(spark):
    rows = [np.sin(2 * np.pi * 4 * T64), np.full(64, 2.0), [1.0], None, [math.nan] * 64]
    got = one(column(spark, rows).select("i", signals.band("x", 64.0, (2.0, 8.0), (1.0, 32.0)).alias("f")))
    assert got[0].peak == 4 and got[0].ratio > 0.9 and all(r.ratio is None for r in got[2:])


def response(f, low, high, rate, order=4):
    """Gain of a Butterworth band-pass at f, from its analog definition."""
    warp = lambda g: np.tan(np.pi * g / rate)
    w, a, b = warp(f), warp(low), warp(high)
    return 1 / np.sqrt(1 + ((w * w - a * b) / (w * (b - a))) ** (2 * order))


@pytest.mark.parametrize(("low", "high"), [(0.5, 8.0), (0.7, 4.0), (2.0, 20.0)])
def test_band_pass_has_butterworth_gain_and_no_delay(low, high):
    sections, gain = signals.band_pass_sections(low, high, 64.0, 4)
    for f in (low / 2, low, (low * high) ** 0.5, high, min(2 * high, 30)):
        z = np.exp(-2j * np.pi * f / 64)
        h = gain * np.prod([(1 - z**2) / (1 + a * z + b * z * z) for a, b in sections])
        assert math.isclose(abs(h), response(f, low, high, 64.0), rel_tol=1e-6)
    t = np.arange(64 * 60) / 64
    mid = (low * high) ** 0.5
    x = np.sin(2 * np.pi * mid * t)
    y = signals.zero_phase(x[None], sections, gain)[0]
    assert np.abs(y - x)[640:-640].max() < 0.02  # both ways: the gain squared, 1 in the middle, and no shift


def test_band_pass_of_mixed_sines(spark):
    t = np.arange(30 * 64) / 64
    x = np.sin(2 * np.pi * 2 * t) + 2 * np.sin(2 * np.pi * 0.1 * t)
    z = one(column(spark, [x, x[:15], None]).select("i", signals.band_pass("x", 64.0, 0.5, 8.0, scale="zscore").alias("f")))
    r = np.array(one(column(spark, [x]).select("i", signals.band_pass("x", 64.0, 0.5, 8.0, scale="robust").alias("f")))[0])
    assert math.isclose(np.median(r), 0, abs_tol=1e-9) and math.isclose(np.subtract(*np.quantile(r, [0.75, 0.25])), 1, rel_tol=1e-9)
    y = np.array(z[0])
    assert abs(y.mean()) < 1e-6 and math.isclose(y.std(), 1, rel_tol=1e-6) and np.corrcoef(y, np.sin(2 * np.pi * 2 * t))[0, 1] > 0.9
    assert z[1] is None and z[2] is None
    for low, high in ((0, 8), (8, 4), (1, 32)):
        with pytest.raises(ValueError):
            signals.band_pass_sections(low, high, 64.0, 4)


def test_quality_index_refuses_what_is_out_of_range(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0.5, 0.0), (0.1, 1.0, 0.5, 0.0)], "a double, b double, c double, d double")
    q = signals.quality_index(*(F.col(c) for c in "abcd"))
    assert [round(r.q, 6) for r in df.select(q.alias("q")).collect()] == [round((1 * 0.5 * 0.5 * 1) ** 0.25, 6), 0.0]
    with pytest.raises(Exception, match="out of its range"):
        spark.createDataFrame([(0.0, 1.0, 1.5, 0.0)], "a double, b double, c double, d double").select(q).collect()


def newton(x, y, penalty=1.0, steps=60):
    x = np.column_stack([np.ones(len(x)), x])
    b, ridge = np.zeros(x.shape[1]), np.diag([1e-9] + [penalty] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
    return b


def test_logistic_models_side_by_side(spark):
    x = RNG.normal(size=(300, 2))
    y = (x[:, 0] + RNG.normal(size=300) > 0.3).astype(int)
    rows = spark.createDataFrame([(int(k % 3), float(a), float(b), int(t)) for k, ((a, b), t) in enumerate(zip(x, y, strict=True))], "m int, a double, b double, y int")
    got = {r.m: np.array(r.beta) for r in models.logistic(rows, "m", ["a", "b"], "y").collect()}
    for m in range(3):
        assert np.allclose(got[m], newton(x[m::3], y[m::3]), atol=1e-5)


def test_softmax_is_the_minimum_of_the_summed_loss(spark):
    x = RNG.normal(size=(400, 2))
    label = np.array(["a", "b", "c"])[np.argmax(np.column_stack([x[:, 0], x[:, 1], -x.sum(axis=1)]) + RNG.gumbel(size=(400, 3)), axis=1)]
    rows = spark.createDataFrame([(float(p), float(q), str(t)) for (p, q), t in zip(x, label, strict=True)], "p double, q double, y string")
    found = models.softmax(rows, ["p", "q"], "y", ["a", "b", "c", "never"])(rows).collect()
    prob = np.array([r.probability for r in found])
    assert np.allclose(prob.sum(axis=1), 1) and (prob[:, 3] == 0).all()
    hit = np.array([[r.y == c for c in "abc"] for r in found]).astype(float)
    at = np.column_stack([[r.p for r in found], [r.q for r in found]])
    # At the minimum the loss's slope along every coefficient is the penalty's: x.T (p - y) = -w, and of the intercepts 0.
    slope, logs = at.T @ (hit - prob[:, :3]), np.log(prob[:, :3])
    w = np.linalg.lstsq(np.column_stack([np.ones(400), at]), logs - logs.mean(axis=1, keepdims=True), rcond=None)[0][1:]
    assert np.allclose((hit - prob[:, :3]).sum(axis=0), 0, atol=0.05) and np.allclose(slope, w, atol=0.05)


def test_ridge(spark):
    x = RNG.normal(size=(200, 2)) * [1, 5]
    y = x @ [2.0, -1.0] + 3 + RNG.normal(size=200)
    rows = spark.createDataFrame([(0, float(a), float(b), float(t)) for (a, b), t in zip(x, y, strict=True)], "m int, a double, b double, y double")
    beta = np.array(models.ridge(rows, "m", ["a", "b"], "y").first().beta)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    own = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean())) / x.std(axis=0)
    assert np.allclose(beta[1:], own) and math.isclose(beta[0], y.mean() - own @ x.mean(axis=0))


def test_joins_hold_their_contracts(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    right = spark.createDataFrame([(1, "x"), (3, "y")], "k long, v string")
    assert joins.join_one_to_one(left, right, ["k"], suffixes=("_primary", "_candidate")).collect() == [(1, "a", "x")]
    with pytest.raises(ValueError, match="not one to one"):
        joins.join_one_to_one(left, right, ["k"], complete=True)
    with pytest.raises(ValueError, match="not one to one"):
        joins.join_one_to_one(left, right.union(right), ["k"])
    assert sorted(joins.lookup(left, left.select("k", F.upper("v").alias("w")), ["k"]).collect()) == [(1, "a", "A"), (2, "b", "B")]
    with pytest.raises(Exception, match="no entry for"):
        joins.lookup(left, right.select("k"), ["k"]).collect()


def test_no_row_depends_on_where_slices_end(spark):
    """The same rows for any width of slice, among them gaps, equal times and keys with one row, or null."""
    rows = [(e, int(k) if k < 4 else None, int(t)) for e, (k, t) in enumerate(zip(RNG.integers(0, 5, 400), np.sort(RNG.integers(0, 3000, 400)), strict=True))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), (F.col("s") % 17).cast("double").alias("value"))
    second = 1_000_000

    def results(width):
        out = {
            "islands": ts.islands(df, "user_id", 20 * second, width=width).select("event_id", "gap", "island"),
            "tumbling": ts.tumbling(df, "user_id", 3, 60 * second, width=width).select("event_id", "island", "block"),
            "smooth": ts.smooth(df, "user_id", "median3", width=width).select("event_id", "smoothed"),
            "slope": ts.trailing_slope(df, "user_id", 200 / 86400, width=width).select("event_id", F.round("slope", 6), "support", "first_point"),
            "merged": ts.merge_spans(ts.spans(df, "user_id", 9 * second, width=width).select("user_id", "span_start", (F.col("span_end") + 5 * second).alias("span_end")), "user_id", width=width),
            "next": joins.next_as_of(df.where("event_id % 2 = 0").select("event_id", "user_id", "ts"), df.where("event_id % 7 = 1").select("user_id", "ts", "value"), "user_id", "ts", "value", width=width).select("event_id", "value"),
        }
        return {k: sorted(map(tuple, v.collect()), key=str) for k, v in out.items()}

    whole = results(10**12)
    assert all(whole.values())
    assert results(37 * second) == whole and results(1000 * second) == whole


def test_one_long_key_is_many_tasks(spark):
    """A million rows of one key: no task of the windows along it reads more than a slice or two."""
    df = spark.range(1_000_000, numPartitions=4).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"))
    rows = ts.islands(df, "user_id", 5_000_000, width=10_000 * 1_000_000)
    sizes = [r["count"] for r in rows.groupBy("user_id", sequences.SLICE).count().collect()]
    assert len(sizes) == 100 and max(sizes) == 10_000
    assert rows.agg(F.max("island")).first()[0] == 0


def test_places_and_reserve(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).cast("int").alias("s"))
    got = evaluation.places(df, ["k"]).select("place", "k").orderBy("place").collect()
    assert [(r.place, r.k) for r in got] == [(i + 1, i) for i in range(5000)]
    held = {r.s: (r.n, r.h) for r in evaluation.reserve(df, "k", "s", 0.2).groupBy("s").agg(F.count("*").alias("n"), F.count_if("reserved").alias("h")).collect()}
    assert all(h == math.ceil(0.2 * n) for n, h in held.values())


def test_queries_without_sql_run(spark):
    """Each gives its rows, and what can be said of them holds."""
    from tidemark.plans import catalogue

    d, found = "/root/testdata/sf0.01", catalogue.queries()
    # Those of plans/runners and n12_signal_windows have tests of their own.
    elsewhere = {n for n in found if n.startswith(("m05_", "m21_fitted", "m22_fitted", "m23_fitted", "m24_fitted"))} - {"m05_baseline_suite"} | {"n12_signal_windows"}
    names = sorted(set(found) - set(catalogue.oracle_sql()) - elsewhere)
    assert set(names) == {"m03_logistic", "m05_baseline_suite", "m09_cross_validation", "m09_fold_summary", "m19_permutation_null", "n04_channel_features", "n05_peaks", "n08_band_pass", "n12_conditioned_windows"}
    got = {n: found[n](spark, d).collect() for n in names}
    assert len(got["n04_channel_features"]) == len(got["n05_peaks"]) == len(got["n08_band_pass"]) == len(got["n12_conditioned_windows"]) == 500
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    for r in got["n05_peaks"][:100]:
        x = vectors[r.vec_id] - vectors[r.vec_id].mean()
        at = slow_peaks(x.tolist(), 16, 0.1 * x.std())
        gaps = np.diff([p for p, _ in at]) / 64
        assert math.isclose(r.prominence_mean, np.mean([h for _, h in at]) if at else 0, abs_tol=1e-9) and math.isclose(r.bpm, 60 / gaps.mean() if len(gaps) else 0, abs_tol=1e-9)
    assert all(abs(r["mean"]) < 1e-6 and math.isclose(r["std"], 1, abs_tol=1e-6) and 0 <= r.band_ratio <= 1 for r in got["n12_conditioned_windows"])
    assert {r.model for r in got["m05_baseline_suite"]} == {"majority", "always_view", "logistic_all", "logistic_value", "logistic_shifted"} and all(0 <= r.macro_f1 <= 1 for r in got["m05_baseline_suite"])
    assert sorted((r.repeat, r.fold) for r in got["m09_cross_validation"]) == [(0, -1), *((r, f) for r in range(1, 21) for f in range(5))]
    assert {r.metric for r in got["m09_fold_summary"]} == {"macro_f1", "balanced_accuracy"} and all(r.q025 <= r.q50 <= r.q975 for r in got["m09_fold_summary"])
    assert got["m19_permutation_null"][0].permutations == 1000 and round(1 / 1001, 6) <= got["m19_permutation_null"][0].p <= 1
    assert all(math.isclose(sum(r.probability), 1, abs_tol=1e-3) for r in got["m03_logistic"])
