"""Fold-local cross-validation and permutations against one fit at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds

RNG = np.random.default_rng(12)
N, FEATURES = 120, ["a", "b"]


def slow_fit(z, y, penalty=1.0):
    z = np.column_stack([np.ones(len(z)), z])
    b, ridge = np.zeros(z.shape[1]), np.diag([1e-9] + [penalty] * (z.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ b)
    return b


@pytest.fixture(scope="module")
def data(spark):
    x = RNG.normal(size=(N, 2)) * [1, 30] + [0, 500]
    y = (x[:, 0] + RNG.normal(size=N) > 0.4).astype(int)
    x[RNG.random(N) < 0.2, 1] = np.nan
    rows = spark.createDataFrame([(i, int(t), float(a), None if np.isnan(b) else float(b)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))], "id long, y int, a double, b double").repartition(3)
    dealt = rows.join(folds.repeated_folds(rows, "id", "y", 4, 3), "id")
    own = {r["id"]: r["folds"] for r in dealt.collect()}
    return x, y, np.array([own[i] for i in range(N)]), dealt


def learned(x, train):
    median = np.nanmedian(x[train], axis=0)
    full = np.where(np.isnan(x), median, x)
    return median, full, full[train].mean(axis=0), full[train].std(axis=0)


def test_strata_are_dealt_evenly_in_every_repeat(data, spark):
    _, y, of, dealt = data
    for r in range(3):
        for c in (0, 1):
            sizes = np.bincount(of[y == c, r], minlength=4)
            assert sizes.max() - sizes.min() <= 1
    assert not (of[:, 0] == of[:, 1]).all()
    small = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "a")], "id long, y string")
    assert folds.fold_count(small, "y") == 2
    for rows in (small.where("id < 4"), small.limit(0)):
        with pytest.raises(ValueError, match="two rows"):
            folds.fold_count(rows, "y")


def test_slices_do_not_change_the_deal(data, spark, monkeypatch):
    _, _, of, dealt = data
    monkeypatch.setattr(folds, "SLICE_ROWS", 9)
    again = {r["id"]: r["folds"] for r in folds.repeated_folds(dealt.drop("folds"), "id", "y", 4, 3).collect()}
    assert all(again[i] == of[i].tolist() for i in range(N))


def test_each_fit_is_prepared_and_fitted_on_its_training_rows_alone(data):
    x, y, of, dealt = data
    fits = folds.fits_of(folds.preparation(dealt, FEATURES, 4), FEATURES)
    assert [(f.repeat, f.fold) for f in fits] == [(r, k) for r in (1, 2, 3) for k in range(4)]
    ready = folds.with_row(dealt, FEATURES, "y", "id")
    betas = folds.logistic_fits(ready, fits)
    got = sorted(map(tuple, folds.held_out(ready, fits, betas).select("repeat", "fold", "label", F.round("p", 6)).collect()))
    want = []
    for f, beta in zip(fits, betas, strict=True):
        train = of[:, f.repeat - 1] != f.fold
        median, full, mean, std = learned(x, train)
        assert np.allclose(f.median, median) and np.allclose(f.mean, mean) and np.allclose(f.std, std)
        own = slow_fit((full[train] - mean) / std, y[train])
        assert np.allclose(beta, own, atol=1e-6)
        z = np.column_stack([np.ones(N), (full - mean) / std])[~train]
        want += [(f.repeat, f.fold, int(t), round(float(p), 6)) for t, p in zip(y[~train], 1 / (1 + np.exp(-z @ own)), strict=True)]
    assert np.allclose(np.array(got, float), np.array(sorted(want), float), atol=2e-6) and len(got) == 3 * N


def test_permutations_by_matrices_equal_one_at_a_time(data, monkeypatch):
    monkeypatch.setattr(folds, "BLOCK", 3)
    x, y, of, dealt = data
    fits = [f for f in folds.fits_of(folds.preparation(dealt, FEATURES, 4), FEATURES) if f.repeat == 1]
    ready = folds.with_row(dealt, FEATURES, "y", "id")
    made = folds.permutations(ready, 2, 7, int(y.sum()))
    confusion = folds.permutation_null(ready, fits, made)
    hashes = {r["id"]: r["h"] for r in dealt.select("id", F.xxhash64("id").alias("h")).collect()}
    labels = made.labels(np.array([hashes[i] for i in range(N)]).view(np.uint64), slice(0, 7)).astype(int)
    # Each permutation has as many ones as the labels, and no two are alike.
    assert (labels.sum(axis=0) == y.sum()).all() and len({tuple(c) for c in labels.T}) == 7
    for p in range(7):
        counts = np.zeros((2, 2), int)
        for f in fits:
            train = of[:, 0] != f.fold
            _, full, mean, std = learned(x, train)
            z = (full - mean) / std
            b = slow_fit(z[train], labels[train, p])
            guess = (np.column_stack([np.ones(N), z])[~train] @ b >= 0).astype(int)
            np.add.at(counts, (guess, labels[~train, p]), 1)
        assert confusion[p].tolist() == counts.ravel().tolist()
    hit = np.diag(counts)
    assert np.isclose(folds.macro_f1(confusion)[6], np.mean(2 * hit / (counts.sum(axis=0) + counts.sum(axis=1))))


def test_a_null_is_decisive(data):
    from tidemark.plans import study

    for count in (499, 1001):
        with pytest.raises(ValueError):
            study.permuted_scores(data[3], 4, count)
