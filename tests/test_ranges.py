"""Places within a group do not depend on how its values are cut into ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import distribution
from tidemark.plans import catalogue


def test_places_like_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), "ab"[int(k > 30)], float(v)) for k, v in enumerate(rng.integers(0, 90, 400))] + [(400, "a", 1e12), (401, None, 3.0)]
    df = spark.createDataFrame(rows, "id long, kind string, v double")
    for most in (3, 20, 1 << 20):
        got = {r.id: (r.below, r.same, r.total) for r in distribution.placed(df, "kind", "v", most).collect()}
        for i, kind, v in rows:
            own = [x for _, k, x in rows if k == kind]
            assert got[i] == (sum(x < v for x in own), own.count(v), len(own))


@pytest.mark.parametrize("most", [2, 15, 1 << 20])
def test_quantiles_like_numpy(spark, most):
    """Many groups at once, one with most rows and repeated values, whatever the size at which a range is cut."""
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(0, 1e6, 500), "b": np.repeat([1.0, -2.0], [40, 3]), "c": np.array([5.0]), None: rng.exponential(1, 60) * 10.0 ** rng.integers(-300, 300, 60), "d": np.array([0.0, -0.0, 1e-320, -1e308, 1e308])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r["k"]: r for r in distribution.quantiles(df, "k", "v", {"low": 0.1, "mid": 0.5, "top": 1.0}, most=most).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        s = np.sort(vs)
        for name, p in (("low", 0.1), ("mid", 0.5), ("top", 1.0)):
            at = (len(s) - 1) * p
            a, b = s[int(np.floor(at))], s[int(np.ceil(at))]
            assert got[k][name] == pytest.approx(a + (b - a) * (at - np.floor(at)), rel=1e-12)
    # A histogram, and the lower of two middle values.
    h = df.where("v IS NOT NULL").groupBy("k", "v").count()
    low = {r["k"]: r["m"] for r in distribution.quantiles(h, "k", "v", {"m": 0.5}, lower=True, count="count", most=most).collect()}
    assert low == {k: np.sort(vs)[(len(vs) - 1) // 2] for k, vs in groups.items()}
    assert distribution.quantiles(df.limit(0), "k", "v", {"m": 0.5}).count() == 0


def test_a_group_of_many_rows_is_many_tasks(spark):
    """Three million rows of one group: what is sorted at once is far less, and the medians are exact."""
    n = 3_000_001
    df = spark.range(n, numPartitions=4).select(F.lit("one").alias("k"), (F.col("id") * 7919 % n).cast("double").alias("v"))
    (r,) = distribution.quantiles(df, "k", "v", {"q": 0.25, "m": 0.5}, most=50_000).collect()
    assert (r["q"], r["m"]) == ((n - 1) * 0.25, (n - 1) / 2)


def test_no_window_over_a_whole_group(spark):
    sf = "/root/testdata/sf0.001"
    for name, group in (("a32_ecdf", "o_orderstatus"), ("a14_spearman", "event_type")):
        plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "cume_dist" not in plan and "rank(" not in plan, (name, group)
