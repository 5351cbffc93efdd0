"""Theil-Sen slopes: the median over all pairs of points, without making the pairs where there are many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FEW = 128  # points of which all pairs are made


def _not_above(t: np.ndarray, v: np.ndarray, slope: float) -> int:
    """Pairs of points, t ascending and different, whose slope is not above `slope`: those that v - slope t does not keep
    in rising order, counted by a merge sort whose levels are each one sort of all blocks."""
    rank = np.unique(v - slope * t, return_inverse=True)[1].astype(np.int64)
    n, found, width = len(rank), 0, 1
    place = np.arange(n)
    while width < n:
        # Sorted by block, rank and side: how many of a block's left half are not below each of its right half.
        key = np.sort((place // (2 * width) * n + rank) * 2 + (place // width % 2 == 0))
        is_left, block = key & 1, key // (2 * n)
        lefts = np.cumsum(is_left)
        ends = np.flatnonzero(np.append(block[1:] != block[:-1], True))
        found += int((lefts[ends][block] - lefts)[is_left == 0].sum())
        width *= 2
    return found


def _ordered(x: float) -> int:
    """A whole number that grows with a double, next numbers for next doubles."""
    bits = int(np.float64(x).view(np.int64))
    return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF)


def _double(n: int) -> float:
    return float(np.int64(n).view(np.float64)) if n >= 0 else -float(np.int64(-n).view(np.float64))


def median_slope(t: np.ndarray, v: np.ndarray) -> float | None:
    """The median slope over pairs of points at different times; None if there are none. n log n memory-free of pairs:
    the slope below which half of the pairs lie is found by halving the doubles between the extremes."""
    order = np.lexsort((v, t))
    t, v = t[order].astype(float), v[order].astype(float)
    t = t - t[0] if len(t) else t
    same = np.unique(t, return_counts=True)[1]
    pairs = len(t) * (len(t) - 1) // 2 - int((same * (same - 1) // 2).sum())
    if not pairs:
        return None
    # Pairs of one time are in rising order of v, so they count as above any slope.
    step = np.diff(t)
    reach = (v.max() - v.min()) / step[step > 0].min()
    middle = []
    for k in ((pairs - 1) // 2 + 1, pairs // 2 + 1):
        low, high = _ordered(-reach) - 1, _ordered(reach) + 4
        while high - low > 1:
            at = (low + high) // 2
            if _not_above(t, v, _double(at)) - _ties(t, v) >= k:
                high = at
            else:
                low = at
        middle.append(_double(high))
    return (middle[0] + middle[1]) / 2


def _ties(t: np.ndarray, v: np.ndarray) -> int:
    """Pairs of one time and one value, which never rise."""
    same = np.unique(np.column_stack([t, v]), axis=0, return_counts=True)[1]
    return int((same * (same - 1) // 2).sum())


def _few(t: np.ndarray, v: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """The median slope of each row of points over its pairs at different times, and which rows have such a pair."""
    a, b = np.triu_indices(t.shape[1], 1)
    apart = t[:, b] - t[:, a]
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(apart != 0, (v[:, b] - v[:, a]) / (apart / float(unit)), np.nan)
    slope.sort(axis=1)  # what is left out comes last
    pairs = (apart != 0).sum(axis=1)
    place, row = np.maximum(pairs - 1, 0) / 2, np.arange(len(t))
    low, high = slope[row, np.floor(place).astype(int)], slope[row, np.ceil(place).astype(int)]
    with np.errstate(invalid="ignore"):
        return np.where(place == np.floor(place), low, low + (high - low) * 0.5), pairs > 0


def theil_sen(points: str, unit: int, few: int = FEW) -> Column:
    """The median slope, per `unit` of t, over all pairs of an array of (t, value) at different t; points of null value
    are left out. Up to `few` points all pairs are made, those of rows with equally many points at once; beyond it
    slopes are counted."""

    @F.arrow_udf("double")
    def run(t: pa.Array, value: pa.Array) -> pa.Array:
        n = np.nan_to_num(t.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        row, flat = np.repeat(np.arange(len(n)), n), value.flatten()
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        row, at, v = row[known], t.flatten().to_numpy(zero_copy_only=False)[known], flat.to_numpy(zero_copy_only=False).astype(float)[known]
        n = np.bincount(row, minlength=len(n))
        begin, out, met = np.cumsum(n) - n, np.zeros(len(n)), np.zeros(len(n), bool)
        for size in np.unique(n[n > 1]):
            rows = np.flatnonzero(n == size)
            if size > few:
                for r in rows:
                    found = median_slope(at[begin[r] : begin[r] + size] / float(unit), v[begin[r] : begin[r] + size])
                    met[r], out[r] = found is not None, found or 0.0
                continue
            step = max(1, (1 << 20) // int(size * size))
            for own in (rows[k : k + step] for k in range(0, len(rows), step)):
                places = begin[own][:, None] + np.arange(size)
                out[own], met[own] = _few(at[places], v[places], unit)
        return pa.array(out, pa.float64(), mask=~met)

    part = lambda name, kind: F.transform(points, lambda p: p[name].cast(kind))
    return run(part("t", "long"), part("value", "double"))
