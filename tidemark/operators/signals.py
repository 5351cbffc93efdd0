"""Kernels on array columns; rows with null or empty arrays give null.

What higher-order functions can say stays in the JVM. Spectra, peaks and recursive filters run over Arrow batches, with
numpy across all rows of a batch that have the same length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(values: str | Column) -> Column:
    return (F.col(values) if isinstance(values, str) else values).cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is worked out once and not once for every element that asks for it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def finite(values: str | Column) -> Column:
    """The values that are neither null nor NaN nor infinite."""
    return F.filter(_doubles(values), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def quantile(ascending: Column, p: float) -> Column:
    """The quantile of a sorted array between its two nearest values; null for an empty one."""
    place = (F.size(ascending) - 1) * F.lit(p)
    low, high = (F.get(ascending, k(place).cast("int")) for k in (F.floor, F.ceil))
    return F.when(F.size(ascending) > 0, low + (high - low) * (place - F.floor(place)))


def moments(values: str | Column) -> Column:
    """Struct of statistics of the finite values: n, mean, std (of the population), min, q25, median, q75, max,
    unique_share, flat_share (of steps), extrema_share, and the adjusted skew and kurtosis (null where undefined)."""
    return _let(finite(values), lambda x: _let(F.struct(F.try_divide(_sum(x), F.size(x)).alias("mean"), F.array_min(x).alias("low"), F.array_max(x).alias("high"), F.array_sort(x).alias("s")), lambda k: _moments(x, k)))


def _moments(x: Column, known: Column) -> Column:
    mean, low, high, s, n = known["mean"], known["low"], known["high"], known["s"], F.size(x).cast("double")
    start = F.struct(*(F.lit(0.0).alias(f"p{k}") for k in (2, 3, 4)), F.lit(0.0).alias("extrema"))
    add = lambda a, v: F.struct(*((a[f"p{k}"] + F.pow(v - mean, F.lit(k))).alias(f"p{k}") for k in (2, 3, 4)), (a["extrema"] + F.when((v == low) | (v == high), 1.0).otherwise(0.0)).alias("extrema"))
    less = F.greatest(F.size(x) - 1, F.lit(0))
    steps = F.zip_with(F.slice(x, 1, less), F.slice(x, 2, less), lambda a, b: b - a)

    def fields(p: Column) -> Column:
        m2, m3, m4 = (F.try_divide(p[f"p{k}"], n) for k in (2, 3, 4))
        own = {"n": n, "mean": mean, "std": F.sqrt(m2), "min": low, "q25": quantile(s, 0.25), "median": quantile(s, 0.5), "q75": quantile(s, 0.75), "max": high}
        own |= {"unique_share": F.try_divide(F.size(F.array_distinct(s)).cast("double"), n), "flat_share": F.try_divide(F.size(F.filter(steps, lambda v: v == 0)).cast("double"), less), "extrema_share": F.try_divide(p["extrema"], n)}
        own["skew"] = F.when((n > 2) & (m2 > 0), F.sqrt(n * (n - 1)) / (n - 2) * m3 / F.pow(m2, F.lit(1.5)))
        own["kurtosis"] = F.when((n > 3) & (m2 > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6))
        return F.struct(*(c.alias(k) for k, c in own.items()))

    return _let(F.aggregate(x, start, add), fields)


def batched(kind: str, fn: Callable[[np.ndarray], list | np.ndarray], least: int = 1) -> Callable[[Column], Column]:
    """A function of an array column: fn gets a matrix of all rows of a batch that have one length (of `least` or more)
    and are finite, and gives a result for each; other rows get null."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        out: list = [None] * len(values)
        sizes: dict[int, list[int]] = {}
        for i, v in enumerate(values):
            if v is not None and len(v) >= least and np.isfinite(np.asarray(v, dtype=float)).all():
                sizes.setdefault(len(v), []).append(i)
        for at in sizes.values():
            for i, r in zip(at, fn(np.stack([np.asarray(values.iloc[i], dtype=float) for i in at])), strict=True):
                out[i] = r
        return pd.Series(out)

    return run


def straightened(x: np.ndarray) -> np.ndarray:
    """Each row less its least-squares line."""
    t = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
    centred = x - x.mean(axis=1, keepdims=True)
    return centred - (centred @ t / max((t * t).sum(), 1e-300))[:, None] * t


def spectra(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, powers by row); only ratios of powers and their maximum are of use, so no scale is applied but
    that of a one-sided spectrum: the first and, at an even length, the last power count half."""
    power = np.abs(np.fft.rfft(x, axis=1)) ** 2
    weight = np.full(power.shape[1], 2.0)
    weight[0] = 1
    weight[-1] = 1 if x.shape[1] % 2 == 0 else 2
    return np.fft.rfftfreq(x.shape[1], 1 / rate), power * weight


def band(values: str | Column, rate: float, pulse: tuple[float, float], reference: tuple[float, float], detrend: bool = True, one_sided: bool = False) -> Column:
    """Array of the frequency of the largest power in the pulse band, and that band's power over the reference's; null
    where either is empty or has no power. Power is counted as the plain square of the transform, or one-sided."""

    def run(x: np.ndarray) -> list:
        f, p = spectra(straightened(x) if detrend else x, rate)
        p = p if one_sided else np.abs(np.fft.rfft(straightened(x) if detrend else x, axis=1)) ** 2
        inside, all_of = (f >= pulse[0]) & (f <= pulse[1]), (f >= reference[0]) & (f <= reference[1])
        total = p[:, all_of].sum(axis=1)
        if not inside.any():
            return [None] * len(x)
        peak = f[inside][p[:, inside].argmax(axis=1)]
        return [{"peak": a, "ratio": b / c} if c > 0 else None for a, b, c in zip(peak.tolist(), p[:, inside].sum(axis=1).tolist(), total.tolist(), strict=True)]

    return _structs("peak double, ratio double", run)(_doubles(values))


def _structs(fields: str, fn: Callable[[np.ndarray], list], least: int = 2) -> Callable[[Column], Column]:
    """As batched(), for a struct: fn gives a dict or None a row."""
    names = [f.split()[0] for f in fields.split(", ")]

    def lists(x: np.ndarray) -> list:
        return [None if r is None else [r[n] for n in names] for r in fn(x)]

    run = batched("array<double>", lists, least)
    return lambda c: (lambda a: F.struct(*(F.get(a, F.lit(k)).alias(n) for k, n in enumerate(names))))(run(c))


def band_pass_sections(low: float, high: float, rate: float, order: int) -> tuple[np.ndarray, float]:
    """(a1, a2 of each second-order section, gain) of a digital Butterworth band-pass; every numerator is 1 - z^-2."""
    if not 0 < low < high < rate / 2:
        raise ValueError("a band-pass needs 0 < low < high < rate / 2")
    edges = 2 * rate * np.tan(np.pi * np.array([low, high]) / rate)  # where the bilinear transform puts the edges
    width, centre = edges[1] - edges[0], np.sqrt(edges[0] * edges[1])
    unit = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * width / 2
    root = np.sqrt(unit**2 - centre**2)
    analog = np.concatenate([unit + root, unit - root])
    poles = (2 * rate + analog) / (2 * rate - analog)
    gain = (width**order * (2 * rate) ** order / np.prod(2 * rate - analog)).real
    upper = poles[poles.imag > 0]
    if len(upper) < order:  # a wide band has pairs of real poles
        real = np.sort(poles[np.abs(poles.imag) < 1e-12].real)
        pairs = [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2], strict=True)]
        return np.array([*((-2 * p.real, abs(p) ** 2) for p in upper), *pairs]), gain
    return np.stack([-2 * upper.real, np.abs(upper) ** 2], axis=1), gain


def zero_phase(x: np.ndarray, sections: np.ndarray, gain: float) -> np.ndarray:
    """Rows filtered forward and backward, from the steady state, with ends extended by their odd reflection."""
    edge = min(3 * (2 * len(sections) + 1), x.shape[1] - 1)
    padded = np.concatenate([2 * x[:, :1] - x[:, edge:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -edge - 2 : -1]], axis=1)

    def one_way(rows: np.ndarray) -> np.ndarray:
        out = rows * gain
        for a1, a2 in sections:
            # The steady state for a constant input: the section lets none of it through.
            z2 = -out[:, 0]
            z1 = z2.copy()
            for k in range(out.shape[1]):
                u = out[:, k]
                y = u + z1
                z1 = z2 - a1 * y
                z2 = -u - a2 * y
                out[:, k] = y
        return out

    return one_way(one_way(padded)[:, ::-1])[:, ::-1][:, edge : edge + x.shape[1]]


def band_pass(values: str | Column, rate: float, low: float, high: float, order: int = 4, scale: str = "none", least: int = 16) -> Column:
    """The values less their line, within a band, without a shift in time; null for fewer than `least` values.

    scale: none, zscore (mean and deviation of the population) or robust (median and interquartile range).
    """
    sections, gain = band_pass_sections(low, high, rate, order)
    if scale not in ("none", "zscore", "robust"):
        raise ValueError(f"unknown scale {scale}")

    def run(x: np.ndarray) -> list:
        y = zero_phase(straightened(x), sections, gain)
        if scale == "zscore":
            y = (y - y.mean(axis=1, keepdims=True)) / np.maximum(y.std(axis=1, keepdims=True), 1e-12)
        elif scale == "robust":
            q = np.quantile(y, [0.25, 0.5, 0.75], axis=1)[:, :, None]
            y = (y - q[1]) / np.maximum(q[2] - q[0], 1e-12)
        return list(y)

    return batched("array<double>", run, least)(_doubles(values))


def peaks_of(x: np.ndarray, apart: int, rise: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, prominences) of the peaks of one row: a plateau counts at its middle, of peaks closer than `apart` the
    higher one stays, and a peak rises by `rise` at least above the higher of the valleys beside it."""
    starts = np.flatnonzero(np.diff(x, prepend=x[0] - 1) != 0)
    level, ends = x[starts], np.append(starts[1:], len(x)) - 1
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    at = (starts[top] + ends[top]) // 2
    stays = np.ones(len(at), dtype=bool)
    for i in np.argsort(x[at], kind="stable")[::-1]:
        if stays[i]:
            stays &= (np.abs(at - at[i]) >= apart) | (np.arange(len(at)) == i)
    at, found = at[stays], []
    for p in at:
        higher = np.flatnonzero(x > x[p])
        left, right = higher[higher < p].max(initial=-1) + 1, higher[higher > p].min(initial=len(x))
        found.append(x[p] - max(x[left : p + 1].min(), x[p:right].min()))
    prominence = np.array(found)
    keep = prominence >= rise
    return at[keep], prominence[keep]


def pulse(values: str | Column, rate: float) -> Column:
    """Struct of rate a minute, mean and deviation of the peaks' intervals in seconds and of their prominences; zeros
    where there are none."""

    def one(x: np.ndarray) -> dict:
        out = dict.fromkeys(("bpm", "interval_mean", "interval_std", "prominence_mean", "prominence_std"), 0.0)
        if x.std() > 0:
            at, rise = peaks_of(x - x.mean(), max(1, int(0.25 * rate)), max(0.1 * x.std(), np.finfo(float).eps))
            gaps = np.diff(at) / rate
            if len(gaps):
                out |= {"bpm": 60 / gaps.mean(), "interval_mean": gaps.mean(), "interval_std": gaps.std()}
            if len(at):
                out |= {"prominence_mean": rise.mean(), "prominence_std": rise.std()}
        return out

    return _structs("bpm double, interval_mean double, interval_std double, prominence_mean double, prominence_std double", lambda m: [one(x) for x in m])(_doubles(values))


def channel_features(values: str | Column, rate: float) -> Column:
    """Struct of sixteen features of a channel's finite values; what is undefined counts as zero."""
    x = finite(values)
    m, b, p = moments(x), band(x, rate, (0.5, 4.0), (0.1, 10.0), one_sided=True), pulse(x, rate)
    own = {"mean": m["mean"], "std": m["std"], "median": m["median"], "iqr": m["q75"] - m["q25"], "minimum": m["min"], "maximum": m["max"], "range": m["max"] - m["min"], "skew": m["skew"], "kurtosis": m["kurtosis"]}
    own |= {"dominant_hz": b["peak"], "band_ratio": b["ratio"], "bpm": p["bpm"], "interval_mean": p["interval_mean"], "interval_std": p["interval_std"], "prominence_mean": p["prominence_mean"], "prominence_std": p["prominence_std"]}
    return F.struct(*(F.coalesce(c, F.lit(0.0)).alias(n) for n, c in own.items()))


def quality_index(flat: Column, log_iqr: Column, band_ratio: Column, motion: Column) -> Column:
    """(flat * amplitude * band * motion) ** 1/4 within 0 and 1; components out of their ranges fail the query."""
    parts = (flat, log_iqr, band_ratio, motion)
    bad = F.lit(False)
    for c in parts:
        bad = bad | c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (c < 0)
    bad = bad | (band_ratio > 1)
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    found = F.pow(clip(1 - flat / 0.05) * clip(log_iqr / (log_iqr + 1)) * band_ratio * F.exp(-motion), F.lit(0.25))
    return F.when(bad, F.raise_error(F.lit("a component of the quality index is out of its range")).cast("double")).otherwise(clip(found))


def robust_scores(values: str | Column) -> Column:
    """Values less their median over their interquartile range, which counts as 1e-12 at least."""
    y = _doubles(values)
    known = _let(F.array_sort(y), lambda s: F.struct(quantile(s, 0.5).alias("m"), F.greatest(quantile(s, 0.75) - quantile(s, 0.25), F.lit(1e-12)).alias("r")))
    return _let(known, lambda k: F.transform(y, lambda v: (v - k["m"]) / k["r"]))


def detrended(values: str | Column) -> Column:
    """Struct of slope (per place) and residuals from the least-squares line."""
    y = _doubles(values)
    n = F.size(y)
    mid = (n - 1) / F.lit(2.0)
    slope = F.try_divide(_sum(F.transform(y, lambda v, i: (i - mid) * v)), n * (n * n.cast("double") - 1) / 12)
    line = F.struct(F.try_divide(_sum(y), n).alias("mean"), slope.alias("slope"))
    return _let(line, lambda k: F.struct(k["slope"].alias("slope"), F.transform(y, lambda v, i: v - k["mean"] - k["slope"] * (i - mid)).alias("residuals")))


def centred(values: str | Column) -> Column:
    y = _doubles(values)
    return _let(F.try_divide(_sum(y), F.size(y)), lambda mean: F.transform(y, lambda v: v - mean))


def z_scores(values: str | Column) -> Column:
    """Values less their mean over their population deviation, which counts as 1e-12 at least."""

    def scaled(c: Column) -> Column:
        deviation = F.sqrt(F.try_divide(_sum(F.transform(c, lambda v: v * v)), F.size(c)))
        return _let(F.greatest(deviation, F.lit(1e-12)), lambda d: F.transform(c, lambda v: v / d))

    return _let(centred(values), scaled)


def relation(a: Column, b: Column) -> Column:
    """Struct of Pearson r (null for a constant channel), and a's peak-to-peak and deviation over b's."""
    x, y = _doubles(a), _doubles(b)
    dot = lambda p, q: _sum(F.zip_with(p, q, lambda i, j: i * j))
    reach = lambda v: F.array_max(v) - F.array_min(v)
    ratio = F.try_divide(reach(x), reach(y))

    def fields(c: Column) -> Column:
        xx, yy, xy = dot(c["x"], c["x"]), dot(c["y"], c["y"]), dot(c["x"], c["y"])
        return F.struct(F.try_divide(xy, F.sqrt(xx * yy)).alias("pearson"), ratio.alias("range_ratio"), F.sqrt(F.try_divide(xx, yy)).alias("deviation_ratio"))

    return _let(F.struct(centred(x).alias("x"), centred(y).alias("y")), fields)
