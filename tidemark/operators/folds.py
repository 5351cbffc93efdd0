"""Repeated, fold-local cross-validation and label permutations: many small models fitted side by side.

Rows stay where they are; a row says in `folds` which fold it is held out with in each repeat. What a fit prepares
(medians, means, deviations) comes from its own training rows alone. Each Newton step is one pass over the stored rows:
a task works out, block by block, the gradient and Hessian sums of all models at once, Spark adds them up, and the
driver sees as many numbers as models have (never rows). A step reads the rows again, so a lost executor costs a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .distribution import medians

SLICE_ROWS = 1 << 18
BLOCK = 256  # permutations multiplied at once


def fold_count(df: DataFrame, stratum: str, most: int = 5) -> int:
    """As many folds as the rarest class has rows, `most` at most; fewer than two is an error."""
    rarest = df.groupBy(stratum).count().agg(F.min("count")).first()[0]
    if not rarest or rarest < 2:
        raise ValueError(f"cross-validation needs two rows of each {stratum} at least, the rarest has {rarest or 0}")
    return min(most, rarest)


def repeated_folds(df: DataFrame, identity: str, stratum: str, folds: int, repeats: int) -> DataFrame:
    """identity and folds: an array with the fold (from 0) in each repeat. In each, every stratum is dealt out evenly, in
    the order of the digests of repeat and identity.

    Digests are cut into slices that hold some 2^18 rows, numbered inside and moved by the counts of those before.
    """
    rows = df.select(identity, stratum).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    slices = min(1 << 16, 1 + df.count() // SLICE_ROWS)
    rows = rows.withColumn("digest", F.md5(F.concat_ws(":", F.col("repeat").cast("string"), F.col(identity).cast("string"))))
    rows = rows.withColumn("part", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * slices / (1 << 32)))
    inside = F.row_number().over(Window.partitionBy("repeat", stratum, "part").orderBy("digest", identity))
    counts = rows.groupBy("repeat", F.struct(stratum).alias("of"), "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("repeat", "of").orderBy("part")) - F.col("n")
    base = counts.select(F.struct("repeat", "of", "part").alias("its"), before.alias("before"))
    # A row for each repeat, stratum and slice. Rows that were exploded look small, and would be broadcast in its place.
    placed = rows.withColumn("inside", inside).join(F.broadcast(base), F.struct("repeat", F.struct(stratum).alias("of"), "part") == F.col("its"))
    fold = ((F.col("inside") - 1 + F.col("before")) % folds).cast("int")
    each = placed.groupBy(identity).agg(F.sort_array(F.collect_list(F.struct("repeat", fold.alias("fold")))).alias("f"))
    return each.select(identity, F.transform("f", lambda x: x["fold"]).alias("folds"))


class Fit(NamedTuple):
    """What a fit has learned of its training rows before it is fitted."""

    repeat: int
    fold: int
    median: np.ndarray
    mean: np.ndarray
    std: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        """Rows with a one in front, missing values filled, each feature scaled."""
        z = (np.where(np.isnan(x), self.median, x) - self.mean) / self.std
        return np.concatenate([np.ones((len(z), 1)), z], axis=1)


def training(rows: DataFrame, folds: int) -> DataFrame:
    """rows once for each (repeat, fold) that they train."""
    repeat = F.posexplode("folds").alias("repeat", "own")
    each = rows.select("*", repeat).withColumn("repeat", F.col("repeat") + 1)
    others = F.array_remove(F.sequence(F.lit(0), F.lit(folds - 1)), F.col("own"))
    return each.withColumn("fold", F.explode(others)).drop("own")


def preparation(rows: DataFrame, features: list[str], folds: int) -> DataFrame:
    """repeat, fold, column, median, mean, std of the training rows of each fit; missing values count as the median.

    Two grouped aggregates serve all fits: one selection of all medians, and sums about the overall means.
    """
    train = training(rows.select("folds", *features), folds)
    median = medians(train, ["repeat", "fold"], features)
    centre = rows.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in features)).first()
    off = lambda c: F.col(c).cast("double") - F.lit(float(centre[c]))
    sums = [F.struct(F.lit(c).alias("column"), F.count(c).alias("k"), F.coalesce(F.sum(off(c)), F.lit(0.0)).alias("s"), F.coalesce(F.sum(off(c) * off(c)), F.lit(0.0)).alias("q"), F.lit(float(centre[c])).alias("centre")) for c in features]
    moments = train.groupBy("repeat", "fold").agg(F.count("*").alias("n"), F.array(*sums).alias("m")).select("repeat", "fold", "n", F.explode("m").alias("m")).select("repeat", "fold", "n", "m.*")
    both = moments.join(median, ["repeat", "fold", "column"], "left")
    n, fill = F.col("n").cast("double"), F.coalesce(F.col("median"), F.lit(0.0)) - F.col("centre")
    missing = F.col("n") - F.col("k")
    shift = (F.col("s") + missing * fill) / n
    var = F.greatest((F.col("q") + missing * fill * fill) / n - shift * shift, F.lit(0.0))
    return both.select("repeat", "fold", "column", F.coalesce("median", F.lit(0.0)).alias("median"), (F.col("centre") + shift).alias("mean"), F.sqrt(var).alias("std"))


def fits_of(prepared: DataFrame, features: list[str]) -> list[Fit]:
    """preparation() on the driver: a row for each fit and feature."""
    found: dict[tuple[int, int], dict] = {}
    for r in prepared.collect():
        found.setdefault((r["repeat"], r["fold"]), {})[r["column"]] = r
    of = lambda own, name: np.array([own[c][name] for c in features])
    # A feature that is the same in all training rows, but for rounding, is not scaled.
    scale = lambda own: np.where(of(own, "std") > 1e-9 * np.maximum(1, np.abs(of(own, "mean"))), of(own, "std"), 1.0)
    return [Fit(*key, of(own, "median"), of(own, "mean"), scale(own)) for key, own in sorted(found.items())]


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(features with NaN for missing, label, folds, hash) of each batch that has rows."""
    for b in batches:
        if b.num_rows:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            folds = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield x, b.column(1).to_numpy(), folds, b.column(3).to_numpy().view(np.uint64)


def summed(rows: DataFrame, width: int, shape: tuple[int, int], work: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum over all blocks of rows of what `work` makes of one, an array of the shape; added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for block in _batches(batches, width):
            total += work(*block)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "value"])

    parts = rows.select("x", "label", "folds", "hash").mapInArrow(run, "at bigint, value double")
    got = parts.groupBy("at").agg(F.sum("value").alias("value")).toPandas()  # as many rows as the shape has places
    out = np.zeros(shape[0] * shape[1])
    out[got["at"].to_numpy()] = got["value"].to_numpy()
    return out.reshape(shape)


def newton(step: Callable[[np.ndarray], np.ndarray], models: int, k: int, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Coefficients of all models: step(betas) gives each one's gradient and the upper triangle of its Hessian, without
    the penalty, which spares the intercept. Steps that would go far are shortened."""
    betas, upper = np.zeros((models, k)), np.triu_indices(k)
    ridge = np.diag([1e-9] + [penalty] * (k - 1))
    for _ in range(steps):
        sums = step(betas)
        g = sums[:, :k] - betas @ ridge
        h = np.zeros((models, k, k))
        h[:, upper[0], upper[1]] = sums[:, k:]
        h = h + np.triu(h, 1).transpose(0, 2, 1) + ridge
        move = np.clip(np.linalg.solve(h, g[:, :, None])[:, :, 0], -5, 5)
        betas += move
        if np.abs(move).max(initial=0) < 1e-9:
            break
    return betas


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic_fits(rows: DataFrame, fits: list[Fit], penalty: float = 1.0) -> np.ndarray:
    """Coefficients, intercept first, of a binary logistic regression for each fit, from the rows that it trains on.

    rows: x (array of features, null where missing), label (0 or 1), folds, hash (a number of the row).
    """
    width = len(fits[0].median)
    k = width + 1
    upper = np.triu_indices(k)

    def step(betas: np.ndarray) -> np.ndarray:
        def work(x, label, folds, _):
            out = np.zeros((len(fits), k + len(upper[0])))
            for i, fit in enumerate(fits):
                train = folds[:, fit.repeat - 1] != fit.fold
                z, y = fit.design(x[train]), label[train]
                p = _sigmoid(z @ betas[i])
                out[i, :k] = z.T @ (y - p)
                out[i, k:] = ((z * (p * (1 - p))[:, None]).T @ z)[upper]
            return out

        return summed(rows, width, (len(fits), k + len(upper[0])), work)

    return newton(step, len(fits), k, penalty)


def held_out(rows: DataFrame, fits: list[Fit], betas: np.ndarray) -> DataFrame:
    """repeat, fold, label, p: for each row and repeat the probability of label 1 from the fit that did not see it."""
    width = len(fits[0].median)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, label, folds, _ in _batches(batches, width):
            for fit, beta in zip(fits, betas, strict=True):
                at = folds[:, fit.repeat - 1] == fit.fold
                n = int(at.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, fit.repeat)), pa.array(np.full(n, fit.fold)), pa.array(label[at].astype(np.int64)), pa.array(_sigmoid(fit.design(x[at]) @ beta))], ["repeat", "fold", "label", "p"])

    return rows.select("x", "label", "folds", "hash").mapInArrow(run, "repeat bigint, fold bigint, label bigint, p double")


def _keyed(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (row, permutation)."""
    with np.errstate(over="ignore"):
        h = hashes[:, None] ^ keys[None, :]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(31))


class Permutations(NamedTuple):
    """Label columns: of the rows, those with the least keyed hashes have label 1, as many as there are such rows."""

    keys: np.ndarray
    shift: int
    cut: np.ndarray

    def labels(self, hashes: np.ndarray, some: slice) -> np.ndarray:
        return (_keyed(hashes, self.keys[some]) >> np.uint64(self.shift)) <= self.cut[some]


def permutations(rows: DataFrame, width: int, count: int, ones: int, seed: int = 1) -> Permutations:
    """`count` permutations of binary labels, of which `ones` are 1; the cut of each is found byte by byte, by counting
    hashes over all rows."""
    keys = np.random.default_rng(seed).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    cut, need = np.zeros(count, np.uint64), np.full(count, float(ones))
    if not ones:
        raise ValueError("no row has label 1")
    for level in range(8):
        shift = 56 - 8 * level

        def work(x, label, folds, hashes, cut=cut, shift=shift, level=level):
            out = np.zeros((count, 256))
            for a in range(0, count, BLOCK):
                h = _keyed(hashes, keys[a : a + BLOCK])
                near = (h >> np.uint64(shift + 8)) == cut[a : a + BLOCK] if level else np.ones(h.shape, bool)
                byte = ((h >> np.uint64(shift)) & np.uint64(255)).astype(np.int64)
                at = np.arange(h.shape[1])[None, :] * 256 + byte
                out[a : a + BLOCK] += np.bincount(at[near], minlength=h.shape[1] * 256).reshape(-1, 256)
            return out

        counts = summed(rows, width, (count, 256), work)
        upto = counts.cumsum(axis=1)
        byte = (upto >= need[:, None]).argmax(axis=1)
        each = np.arange(count)
        need = need - (upto[each, byte] - counts[each, byte])
        cut = (cut << np.uint64(8)) | byte.astype(np.uint64)
        if (counts[each, byte] == need).all():
            break
    return Permutations(keys, shift, cut)


def permutation_null(rows: DataFrame, fits: list[Fit], made: Permutations, penalty: float = 1.0) -> np.ndarray:
    """Confusion counts, [predicted, label] in four places, of each permutation pooled over the folds of the fits.

    Features and their preparation don't change, so a fold's models for all permutations are columns of one matrix:
    scores, gradients and Hessians are products of the block's design with it.
    """
    width, count = len(fits[0].median), len(made.keys)
    k = width + 1
    upper = np.triu_indices(k)
    blocks = [slice(a, min(a + BLOCK, count)) for a in range(0, count, BLOCK)]

    def step(betas: np.ndarray) -> np.ndarray:
        b = betas.reshape(len(fits), count, k)

        def work(x, label, folds, hashes):
            out = np.zeros((len(fits), count, k + len(upper[0])))
            for some in blocks:
                y = made.labels(hashes, some)
                for i, fit in enumerate(fits):
                    train = folds[:, fit.repeat - 1] != fit.fold
                    z = fit.design(x[train])
                    p = _sigmoid(z @ b[i, some].T)
                    out[i, some, :k] = (z.T @ (y[train] - p)).T
                    out[i, some, k:] = ((z[:, upper[0]] * z[:, upper[1]]).T @ (p * (1 - p))).T
            return out.reshape(-1, k + len(upper[0]))

        return summed(rows, width, (len(fits) * count, k + len(upper[0])), work)

    b = newton(step, len(fits) * count, k, penalty).reshape(len(fits), count, k)

    def score(x, label, folds, hashes):
        out = np.zeros((count, 4))
        for some in blocks:
            y = made.labels(hashes, some)
            for i, fit in enumerate(fits):
                at = folds[:, fit.repeat - 1] == fit.fold
                guess = fit.design(x[at]) @ b[i, some].T >= 0
                for place, (g, t) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
                    out[some, place] += ((guess == g) & (y[at] == t)).sum(axis=0)
        return out

    return summed(rows, width, (count, 4), score)


def macro_f1(confusion: np.ndarray) -> np.ndarray:
    """Macro-F1 of rows of confusion counts; a class without cases or guesses scores 0."""
    n00, n01, n10, n11 = confusion.T
    of = lambda hit, other: np.where(2 * hit + other > 0, 2 * hit / np.maximum(2 * hit + other, 1), 0.0)
    return (of(n00, n01 + n10) + of(n11, n01 + n10)) / 2


def with_row(df: DataFrame, features: list[str], label: str | Column, identity: str) -> DataFrame:
    """The columns that fits read: x, label, folds, hash."""
    x = F.array(*(F.col(c).cast("double") for c in features))
    return df.select(x.alias("x"), (F.col(label) if isinstance(label, str) else label).cast("double").alias("label"), "folds", F.xxhash64(identity).alias("hash"))
