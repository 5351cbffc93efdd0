"""Contracts on tables with planted faults, and slopes of many points."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import checks, slopes

LABELS = ["FALLING", "STABLE", "RISING"]


def test_bins_match_once(spark):
    df = spark.createDataFrame([(5.59,), (5.6,), (6.99,), (7.0,), (-1e9,)], "v double")
    bins = [("A", None, 5.6), ("B", 5.6, 7.0), ("C", 7.0, None)]
    assert [r["b"] for r in df.select(checks.one_bin(F.col("v"), bins).alias("b")).collect()] == ["A", "B", "B", "C", "A"]
    for bad in ([("A", None, 5.6), ("C", 7.0, None)], [("A", None, 6.0), ("B", 5.6, None)], [("A", 0, 5.6), ("B", 5.6, None)]):
        with pytest.raises(Exception, match="bins that hold"):
            df.select(checks.one_bin(F.col("v"), bad).alias("b")).collect()
    for v in (None, float("nan")):
        with pytest.raises(Exception, match="bins that hold"):
            spark.createDataFrame([(v,)], "v double").select(checks.one_bin(F.col("v"), bins).alias("b")).collect()


def test_every_rule_of_endpoints_can_fire(spark):
    good = [("p", 1, 10, 5, "STABLE", 0.5), ("p", 2, 20, 15, "RISING", 0.5), ("c", 1, 10, 5, "FALLING", 0.3)]
    table = lambda rows: spark.createDataFrame(rows, "candidate string, key long, at long, history_start long, label string, threshold double")
    assert checks.held_endpoints(table(good), LABELS, "p").count() == 3
    faults = {
        "repeated": ("p", 1, 10, 5, "STABLE", 0.5), "unknown": ("p", 3, 10, 5, "UP", 0.5), "no_time": ("p", 3, None, 5, "STABLE", 0.5),
        "late_history": ("p", 3, 10, 11, "STABLE", 0.5), "thresholds": ("p", 3, 10, 5, "STABLE", 0.0),
    }
    for name, row in faults.items():
        found = {r["candidate"]: r for r in checks.endpoint_faults(table([*good, row]), LABELS).collect()}
        assert {c: found["p"][c] for c in checks.FAULTS} == {c: int(c == name) for c in checks.FAULTS} and not any(found["c"][c] for c in checks.FAULTS)
        with pytest.raises(ValueError, match="break their contract"):
            checks.held_endpoints(table([*good, row]), LABELS, "p")
    odd = table([("p", 3, 10, None, None, None), ("p", 4, 10, 5, "STABLE", float("nan"))])
    assert tuple(checks.endpoint_faults(odd, LABELS).first())[1:] == (2, 0, 1, 1, 0, 2)
    for rows, told in ((good[2:], "absent"), ([], "empty")):
        with pytest.raises(ValueError, match=told):
            checks.held_endpoints(table(rows), LABELS, "p")


def test_manifests_say_where_they_come_from():
    good = {"git_commit": "a" * 40, "git_clean": True, "config_sha256": "0" * 64, "source_sha256": "f" * 64, "version": "v1", "created": "2024-01-01T00:00:00Z", "files": {"a.csv": "1" * 64}}
    assert checks.held_manifest(good) is good
    for key, value, code in (("git_clean", False, "BAD_git_clean"), ("git_commit", "abc", "BAD_git_commit"), ("config_sha256", "G" * 64, "BAD_config_sha256"), ("version", None, "MISSING_version"), ("files", {}, "MISSING_files"), ("files", {"b": "12"}, "BAD_files:b"), ("created", 5, "BAD_created")):
        assert checks.provenance_faults({**good, key: value}) == [code]
        with pytest.raises(ValueError, match=code):
            checks.held_manifest({**good, key: value})


def slow(t, v):
    found = [(v[j] - v[i]) / (t[j] - t[i]) for i in range(len(t)) for j in range(len(t)) if t[j] > t[i]]
    return float(np.median(found)) if found else None


def test_slopes_are_counted_like_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):
        n = int(rng.integers(1, 60))
        t = np.sort(rng.integers(0, 40, n)) * 60_000_000 + 1_700_000_000_000_000
        v = rng.choice([np.round(rng.normal(size=n) * 9), rng.normal(size=n), np.zeros(n)][k % 3], n)
        rows.append((k, [(int(a), None if rng.random() < 0.05 else float(b)) for a, b in zip(t, v, strict=True)]))
    df = spark.createDataFrame(rows, "k int, seen array<struct<t:long,value:double>>")
    for few in (1, 1000):
        got = {r["k"]: r["s"] for r in df.select("k", slopes.theil_sen("seen", 3_600_000_000, few).alias("s")).collect()}
        for k, points in rows:
            points = [p for p in points if p[1] is not None]
            want = slow([t / 3_600_000_000 for t, _ in points], [v for _, v in points])
            assert (got[k] is None) == (want is None) and (want is None or got[k] == pytest.approx(want, rel=1e-7, abs=1e-7))


def test_a_hundred_thousand_points():
    rng = np.random.default_rng(5)
    t = np.arange(100_000) / 64
    began = time.perf_counter()
    found = slopes.median_slope(t, 3.5 * t + rng.normal(size=len(t)))
    assert abs(found - 3.5) < 1e-3 and time.perf_counter() - began < 90
