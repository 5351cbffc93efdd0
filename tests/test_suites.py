"""Suites of multinomial models against one fit at a time, and the runners that train them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, suites
from tidemark.plans import catalogue, runners

RNG = np.random.default_rng(8)
CLASSES = ["a", "b", "c"]


def slow_fit(z, y, w, k, penalty=1.0, steps=400):
    """Newton's method on the whole vector of coefficients, by the definition of the loss."""
    z = np.column_stack([np.ones(len(z)), z])
    b = np.zeros((k, z.shape[1]))
    ridge = np.diag(np.tile([1e-9] + [penalty] * (z.shape[1] - 1), k))
    for _ in range(steps):
        e = np.exp(z @ b.T)
        p = e / e.sum(axis=1, keepdims=True)
        g = sum((np.kron(w[i] * (np.eye(k)[y[i]] - p[i]), z[i]) for i in range(len(z))), -ridge @ b.ravel())
        h = sum((np.kron(w[i] * (np.diag(p[i]) - np.outer(p[i], p[i])), np.outer(z[i], z[i])) for i in range(len(z))), ridge)
        move = np.linalg.solve(h, g)
        b = b + move.reshape(b.shape)
        if np.abs(move).max() < 1e-10:
            break
    return b


@pytest.mark.parametrize("balanced", [False, True])
def test_suite_equals_one_fit_at_a_time(spark, balanced):
    rows, own = [], {}
    for name, width, classes in (("one", 3, 3), ("two", 1, 3), ("three", 2, 2)):
        x = RNG.normal(size=(90, width)) * 4 + 100
        y = np.argmax((x[:, :1] - 100) * np.arange(classes) / 3 + RNG.gumbel(size=(90, classes)), axis=1)
        w = RNG.choice([0.5, 1.0, 0.0], size=90)
        x[RNG.random((90, width)) < 0.1] = np.nan
        own[name] = (x, y, w, classes)
        rows += [(name, [None if np.isnan(v) else float(v) for v in r] + [0.0] * (3 - width), CLASSES[t], float(v)) for r, t, v in zip(x, y, w, strict=True)]
    rows.append(("one", [1.0, 1.0, 1.0], "unknown", 1.0))
    df = spark.createDataFrame(rows, "model string, x array<double>, label string, weight double").repartition(4)
    suite = suites.fitted(df, CLASSES, balanced)
    assert suite.models == ["one", "three", "two"]
    for i, name in enumerate(suite.models):
        x, y, w, classes = own[name]
        keep = w > 0
        x, y, w = x[keep], y[keep], w[keep]
        median = np.nanmedian(x, axis=0)
        full = np.where(np.isnan(x), median, x)
        z = (full - full.mean(axis=0)) / full.std(axis=0)
        if balanced:
            n = np.bincount(y, minlength=classes)
            w = w * (len(y) / (classes * n))[y]
        want = slow_fit(z, y, w, classes)
        assert np.allclose(suite.betas[i][:classes, 1 : 1 + z.shape[1]], want[:, 1:], atol=1e-5)
        # Intercepts are told but for a common shift.
        gaps = lambda b: b[:, 0] - b[0, 0]
        assert np.allclose(gaps(suite.betas[i][:classes]), gaps(want), atol=1e-4)
        assert suite.met[i].tolist() == [c < classes for c in range(3)]
    got = df.where("label <> 'unknown'").select("model", "label", suite.predicted().alias("p")).collect()
    assert np.mean([r["label"] == r["p"] for r in got]) > 0.5 and not any(r["p"] == "c" for r in got if r["model"] == "three")
    assert df.limit(1).select(F.lit("other").alias("model"), "x").select(suite.predicted().alias("p")).first()["p"] is None


def test_suite_agrees_with_sparks_solver(spark):
    x = RNG.normal(size=(200, 2))
    y = [CLASSES[i] for i in np.argmax(np.column_stack([x, -x.sum(axis=1)]) + RNG.gumbel(size=(200, 3)), axis=1)]
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    df = spark.createDataFrame([(float(a), float(b), t) for (a, b), t in zip(x, y, strict=True)], "p double, q double, label string")
    rows = df.select("*", F.lit("m").alias("model"), F.array("p", "q").alias("x"), F.lit(1.0).alias("weight"))
    suite = suites.fitted(rows, CLASSES)
    other = models.softmax(df, ["p", "q"], "label", CLASSES)(df)
    for r in other.limit(50).collect():
        assert np.allclose(r["probability"], suite.probabilities(0, suite.design(0, np.array([[r["p"], r["q"]]])))[0], atol=1e-3)


def test_no_rows_no_models(spark):
    none = spark.createDataFrame([], "model string, x array<double>, label string, weight double")
    suite = suites.fitted(none, CLASSES)
    assert suite.models == [] and none.select(suite.predicted().alias("p")).count() == 0


def test_runners_train(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    once = runners.endpoints(spark, d)
    monkeypatch.setattr(runners, "endpoints", lambda *_: once)
    got = {n: catalogue.queries()[n](spark, d).collect() for n in ("m05_history_suite", "m21_fitted_policies", "m22_fitted_selection", "m23_fitted_variants", "m24_fitted_sweep")}
    suite = {(r["model"], r["user_id"]): r for r in got["m05_history_suite"]}
    names = {"majority", "always_stable", "logistic_history", "logistic_current_window", "logistic_shifted_control"}
    assert {m for m, _ in suite} == names and len({u for _, u in suite}) > 100
    assert len({suite[m, "all"]["rows"] for m in names}) == 1
    assert suite["always_stable", "all"]["falling_recall"] == 0 and suite["logistic_history", "all"]["falling_recall"] > 0
    assert suite["logistic_history", "all"]["macro_f1"] > suite["logistic_shifted_control", "all"]["macro_f1"]
    variants = {r["model"]: r for r in got["m23_fitted_variants"]}
    assert len(variants) == 9 and variants["levels__report_only"]["retention"] == 1 > variants["levels__hard_exclude"]["retention"]
    assert {r["model"] for r in got["m21_fitted_policies"]} == {f"history__{p}" for p in ("report_only", "soft_weight", "hard_exclude")}
    assert sum(r["chosen"] for r in got["m22_fitted_selection"]) == 1 and all(0 < r["score"] < 1 for r in got["m22_fitted_selection"])
    assert [r["cut"] for r in got["m24_fitted_sweep"]] == runners.CUTS and all(r["verdict"] in ("VIABLE", "NOT_VIABLE") for r in got["m24_fitted_sweep"])
    assert all(r["macro_f1"] is None or math.isfinite(r["macro_f1"]) for r in got["m24_fitted_sweep"])
