"""Multinomial models side by side: a suite of variants, each prepared and fitted on its own training rows.

Rows are (model, x, label, weight): x is an array of features, as long for every row of a model; variants with fewer
features have shorter ones, or are filled up with zeros by `padded`. The training rows are read once and written as
blocks of numbers by model; all that follows reads blocks. Preparation (median, mean, deviation of every feature of
every model) counts digits of the values, from the highest on, so a median takes PLACES passes whatever the values. A
Newton step is one pass in which a task sums gradients and Hessians X'WX of its blocks for each model it meets; Spark
adds them up, and the driver sees numbers by model, never rows. Where there are many blocks the first steps are taken
on some of them: that is only where the steps over all rows begin, and these go on until they move no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import shared_path

BLOCK, GROUP_BYTES = 1024, 16 << 20  # rows of a block; bytes of a row group of blocks
DIGITS, PLACES = 13, 5  # bits of a digit of a number's order, and how many digits there are
BEGIN = 128  # blocks a model that the first steps are taken on


def padded(features: list[Column], width: int) -> Column:
    return F.array(*(c.cast("double") for c in features), *[F.lit(0.0)] * (width - len(features)))


def blocks(train: DataFrame, classes: list[str]) -> DataFrame:
    """model, n, x, label, weight of up to BLOCK rows each, numbers as bytes, and its rows by class (counts); written."""
    c = len(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def given(model: str, least: int) -> Iterator[pa.RecordBatch]:
            x, label, weight = (np.concatenate(p) for p in zip(*held.pop(model), strict=True))
            at = 0
            while len(x) - at >= least and at < len(x):
                own = slice(at, at + BLOCK)
                n = len(x[own])
                cells = [model, n, x[own].tobytes(), label[own].tobytes(), weight[own].tobytes(), np.bincount(label[own], minlength=c).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(cells, kinds, strict=True)], names)
                at += n
            if at < len(x):
                held[model] = [(x[at:], label[at:], weight[at:])]

        for b in batches:
            if not b.num_rows:
                continue
            model, x = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            flat, ends = x.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))
            width = np.diff(ends, prepend=0)
            label, weight = b.column(2).to_numpy(zero_copy_only=False).astype(np.int8), b.column(3).to_numpy(zero_copy_only=False)
            for name in set(model):
                at = np.flatnonzero(model == name)
                w = int(width[at[0]])
                own = flat[(ends[at] - w)[:, None] + np.arange(w)]
                held.setdefault(name, []).append((own, label[at], weight[at]))
                if sum(len(p[1]) for p in held[name]) >= BLOCK:
                    yield from given(name, BLOCK)
        for name in list(held):
            yield from given(name, 1)

    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    names = ["model", "n", "x", "label", "weight", "counts"]
    code = F.array_position(F.array(*map(F.lit, classes)), F.col("label")) - 1
    rows = train.where(F.col("label").isin(classes) & (F.col("weight") > 0))
    rows = rows.select("model", "x", code.cast("int").alias("label"), F.col("weight").cast("double").alias("weight"))
    found = rows.mapInArrow(run, "model string, n long, x binary, label binary, weight binary, counts array<long>")
    return _written(found, "blocks")


def _written(found: DataFrame, name: str) -> DataFrame:
    """As stored(), with row groups so small that a reader never holds many blocks."""
    path = shared_path(found.sparkSession, name)
    bounds = {"parquet.block.size": GROUP_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    found.write.options(**bounds).option("parquet.enable.dictionary", False).parquet(path)
    return found.sparkSession.read.schema(found.schema).parquet(path)


def _added(rows: DataFrame, names: list[str], size: int, own) -> np.ndarray:
    """The sum over all blocks of own(model's place, x, label, weight), of `size` numbers a model; one pass, in which a
    task adds up its own blocks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = {n: i for i, n in enumerate(names)}, {}
        for b in batches:
            for name, n, x, label, weight in zip(*(b.column(k) for k in range(5)), strict=True):
                i, n = place[name.as_py()], n.as_py()
                found = own(i, np.frombuffer(x.as_buffer(), float).reshape(n, -1), np.frombuffer(label.as_buffer(), np.int8), np.frombuffer(weight.as_buffer(), float))
                if i in total:
                    total[i] += found
                else:
                    total[i] = found
        for i, found in total.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(at + i * size), pa.array(found[at].astype(float))], ["at", "value"])

    rows = rows.select("model", "n", "x", "label", "weight")
    got = rows.mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(len(names) * size)
    out[got["at"].to_numpy(dtype=np.int64)] = got["value"].to_numpy()
    return out.reshape(len(names), size)


def _order(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of doubles."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _doubles(order: np.ndarray) -> np.ndarray:
    return np.where(order >> np.uint64(63), order & np.uint64((1 << 63) - 1), ~order).view(float)


def preparation(rows: DataFrame, names: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """median, mean, std by model and place of x over the model's blocks; null and NaN count as the median.

    The values in the two middle places are found digit by digit: counts of a digit among the values that share the
    higher ones. Counts of a digit are 2^DIGITS numbers a feature and middle place, however many rows there are.
    """
    many, m = 1 << DIGITS, len(names)
    found = np.zeros((m, width, 2), np.uint64)  # the digits so far of both middle values
    before = np.zeros((m, width, 2))  # the place of each among the values that share its digits so far
    for k in range(PLACES):
        low = max(0, 64 - DIGITS * (k + 1))
        bits = min(DIGITS, 64 - DIGITS * k)

        def count(i: int, x: np.ndarray, label: np.ndarray, weight: np.ndarray, known=found, low=low, bits=bits, k=k) -> np.ndarray:
            out = np.zeros((width, 2, many), np.int64)
            for f in range(x.shape[1]):
                own = x[:, f]
                o = _order(own[~np.isnan(own)])
                for t in range(2 if k and known[i, f, 0] != known[i, f, 1] else 1):
                    met = o[o >> np.uint64(low + bits) == known[i, f, t]] if k else o
                    if len(met):
                        out[f, t] = np.bincount(((met >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=many)
            return out.ravel()

        counts = _added(rows, names, width * 2 * many, count).reshape(m, width, 2, many)
        if k:
            one = found[..., 0] == found[..., 1]
            counts[one, 1] = counts[one, 0]
        else:
            counts[:, :, 1] = counts[:, :, 0]
            n = counts[:, :, 0].sum(axis=2)
            before = np.stack([np.maximum(n - 1, 0) // 2, n // 2], axis=2)
        upto = np.cumsum(counts, axis=3)
        digit = np.minimum((upto <= before[..., None]).sum(axis=3), many - 1)
        before = before - np.take_along_axis(upto - counts, digit[..., None], axis=3)[..., 0]
        found = (found << np.uint64(bits)) | digit.astype(np.uint64)
    middle = _doubles(found)
    median = np.where(n > 0, middle[..., 0] * 0.5 + middle[..., 1] * 0.5, 0.0)

    def moments(i: int, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.zeros((3, width))
        w = x.shape[1]
        off = np.where(np.isnan(x), 0.0, x - median[i, :w])
        out[0, :w], out[1, :w], out[2, :w] = len(x), off.sum(axis=0), (off**2).sum(axis=0)
        return out.ravel()

    count, first, second = np.moveaxis(_added(rows, names, 3 * width, moments).reshape(m, 3, width), 1, 0)
    count = np.maximum(count, 1)
    return median, median + first / count, np.sqrt(np.maximum(second / count - (first / count) ** 2, 0))


class Suite(NamedTuple):
    """Fitted models: what each learned of its training rows, coefficients by class, and the classes it has met."""

    models: list[str]
    classes: list[str]
    median: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    betas: np.ndarray
    met: np.ndarray

    def design(self, i: int, x: np.ndarray) -> np.ndarray:
        w = x.shape[1]
        z = (np.where(np.isnan(x), self.median[i, :w], x) - self.mean[i, :w]) / self.std[i, :w]
        return np.concatenate([np.ones((len(z), 1)), z], axis=1)

    def probabilities(self, i: int, z: np.ndarray, beta: np.ndarray | None = None) -> np.ndarray:
        score = z @ (self.betas[i] if beta is None else beta)[:, : z.shape[1]].T
        score[:, ~self.met[i]] = -np.inf
        e = np.exp(score - score.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predicted(self, model: str = "model", x: str = "x") -> Column:
        """The likeliest class of each row by its model, the first of equal ones; null for a model that was not fitted."""
        own = self

        @F.arrow_udf("string")
        def run(model: pa.Array, x: pa.Array) -> pa.Array:
            names = model.to_numpy(zero_copy_only=False)
            flat, ends = x.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))
            width = np.diff(ends, prepend=0)
            out = np.full(len(names), None, dtype=object)
            for i, name in enumerate(own.models):
                at = np.flatnonzero(names == name)
                if len(at):
                    w = int(width[at[0]])
                    p = own.probabilities(i, own.design(i, flat[(ends[at] - w)[:, None] + np.arange(w)]))
                    out[at] = np.array(own.classes, dtype=object)[p.argmax(axis=1)]
            return pa.array(out, pa.string())

        return run(F.col(model), F.col(x))


def fitted(train: DataFrame, classes: list[str], balanced: bool = False, penalty: float = 1.0, steps: int = 40, scaled: bool = True) -> Suite:
    """A suite fitted on train (model, x, label, weight), which is read once.

    The loss is summed over rows, with penalty / 2 times the squared coefficients of all classes, intercepts spared.
    balanced: in each model, every class weighs as much as any other. Rows of other labels are left out.
    scaled: features are centred and divided by their deviation; if not, they come as the penalty is to meet them.
    """
    rows = blocks(train, classes)
    c = len(classes)
    own = rows.groupBy("model").agg(F.count("*").alias("blocks"), F.max(F.length("x") / F.col("n") / 8).cast("int").alias("width"), *(F.sum(F.get("counts", k)).alias(f"n{k}") for k in range(c)))
    met = sorted(own.collect(), key=lambda r: r["model"])  # a row for each model
    names = [r["model"] for r in met]
    n = np.array([[r[f"n{k}"] for k in range(c)] for r in met], float).reshape(len(names), c)
    width = max((r["width"] for r in met), default=0)
    if not names:
        return Suite([], classes, *(np.zeros((0, 0)) for _ in range(3)), np.zeros((0, c, 1)), n > 0)
    median, mean, std = preparation(rows, names, width)
    moves = std > 1e-9 * np.maximum(1, np.abs(mean))  # features of one value alone have a coefficient of 0
    mean, std = (mean, np.where(moves, std, 1.0)) if scaled else (np.zeros_like(mean), np.ones_like(std))
    moves = moves | (not scaled)
    suite = Suite(names, classes, median, mean, std, np.zeros((len(names), c, width + 1)), n > 0)
    weights = np.where(n > 0, n.sum(axis=1, keepdims=True) / ((n > 0).sum(axis=1, keepdims=True) * np.maximum(n, 1)), 0.0) if balanced else np.ones_like(n)
    share = sum(r["blocks"] for r in met) // (BEGIN * len(names))
    if share >= 4:
        some = _written(rows.where(F.pmod(F.xxhash64("model", "label", "weight", F.substring("x", 1, 4096)), F.lit(share)) == 0), "begin")
        begun, _ = _newton(some, suite, moves, weights, suite.betas, penalty / share, steps, 1e-3)
        suite = suite._replace(betas=_newton(rows, suite, moves, weights, begun, penalty, steps, 1e-8)[0])
    else:
        suite = suite._replace(betas=_newton(rows, suite, moves, weights, suite.betas, penalty, steps, 1e-8)[0])
    return suite


def _newton(rows: DataFrame, suite: Suite, moves: np.ndarray, weights: np.ndarray, betas: np.ndarray, penalty: float, steps: int, least: float) -> tuple[np.ndarray, int]:
    """Coefficients after Newton's steps from betas until none moves by `least`, and how many steps there were. A model
    whose first coefficients are worse than none begins at zero."""
    m, c, k = betas.shape
    ridge = np.stack([_ridge(met, k - 1, penalty) for met in suite.met])
    cost = lambda b: np.einsum("mi,mij,mj->m", b.reshape(m, -1), ridge, b.reshape(m, -1)) / 2
    for step in range(1, steps + 1):
        g, h, loss, none = _sums(rows, suite, moves, weights, betas)
        worse = ~(loss + cost(betas) <= none * (1 + 1e-9))
        if step == 1 and betas.any() and worse.any():
            betas = np.where(worse[:, None, None], 0.0, betas)
            g, h, loss, none = _sums(rows, suite, moves, weights, betas)
        g = g - np.einsum("mij,mj->mi", ridge, betas.reshape(m, -1))
        move = np.clip(np.linalg.solve(h + ridge, g[:, :, None])[:, :, 0], -5, 5)
        betas = betas + move.reshape(betas.shape)
        if np.abs(move).max() < least:
            break
    return betas, step


def _ridge(met: np.ndarray, width: int, penalty: float) -> np.ndarray:
    """The penalty's Hessian. A shift common to all intercepts changes nothing, so their sum is held at 0."""
    k = width + 1
    out = np.diag(np.tile([0.0] + [penalty] * width, len(met)))
    at = np.arange(len(met)) * k
    out[np.ix_(at[met], at[met])] += 1
    out[at[~met], at[~met]] = 1
    return out


def _sums(rows: DataFrame, suite: Suite, moves: np.ndarray, weights: np.ndarray, betas: np.ndarray) -> tuple[np.ndarray, ...]:
    """By model: gradient, Hessian and loss without the penalty, and the loss of no coefficients at all.

    The classes' parts of the Hessian add up to nothing, so those of the last class follow from the others.
    """
    m, c, k = betas.shape
    pairs = [(u, v) for u in range(c - 1) for v in range(u, c - 1)]

    def run(i: int, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
        z, at = suite.design(i, x), np.flatnonzero(np.concatenate([[True], moves[i, : x.shape[1]]]))
        z, beta = np.ascontiguousarray(z[:, at]), betas[i][:, at]
        w, p = weight * weights[i, label], suite.probabilities(i, z, beta)
        off = w[:, None] * (np.eye(c)[label] - p)
        out, h = np.zeros(c * k + len(pairs) * k * k + 2), np.zeros((len(pairs), k, k))
        g = np.zeros((c, k))
        g[:, at] = off.T @ z
        for j, (u, v) in enumerate(pairs):
            h[j][np.ix_(at, at)] = (z * (w * p[:, u] * ((u == v) - p[:, v]))[:, None]).T @ z
        out[: c * k], out[c * k : -2] = g.ravel(), h.ravel()
        out[-2:] = -(w * np.log(np.maximum(p[np.arange(len(p)), label], 1e-300))).sum(), w.sum() * np.log(suite.met[i].sum())
        return out

    sums = _added(rows, suite.models, c * k + len(pairs) * k * k + 2, run)
    h = np.zeros((m, c, k, c, k))
    for j, (u, v) in enumerate(pairs):
        own = sums[:, c * k + j * k * k : c * k + (j + 1) * k * k].reshape(m, k, k)
        h[:, u, :, v, :] = h[:, v, :, u, :] = own
    h[:, :-1, :, -1, :] = -h[:, :-1, :, :-1, :].sum(axis=3)
    h[:, -1, :, :-1, :] = h[:, :-1, :, -1, :].transpose(0, 2, 1, 3)
    h[:, -1, :, -1, :] = -h[:, -1, :, :-1, :].sum(axis=2)
    return sums[:, : c * k], h.reshape(m, c * k, c * k), sums[:, -2], sums[:, -1]
