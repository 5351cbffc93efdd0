"""Conditioned windows of a raw signal against a slow version, whatever the slices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import conditioning, signals
from tidemark.operators.conditioning import Spec
from tidemark.plans import catalogue, kernels

SECOND, RATE, SAMPLES = 1_000_000, 4.0, 20
SPECS = [Spec("raw"), Spec("band", (0.3, 1.5), "zscore"), Spec("robust", (0.2, 1.0), "robust")]


def stop(t, w):
    """Filtered forward and backward by the definition of the sections, row by row."""
    sections, gain = signals.band_pass_sections(*w, RATE, 4)
    return signals.zero_phase(signals.straightened(t[None, :]), sections, gain)[0]


def slow_windows(samples, gap, stop_at):
    """(key, start, end, values) of whole windows; samples are (key, t, id, v)."""
    out, by = [], {}
    for k, t, i, v in samples:
        if t is not None and v is not None and np.isfinite(v) and k in stop_at and t <= stop_at[k]:
            by.setdefault(k, []).append((t, i, v))
    for k, own in by.items():
        own.sort()
        run = []
        for prior, now in zip([None, *own], own, strict=False):
            if prior and not 0 < now[0] - prior[0] <= gap:
                run = []
            run.append(now)
            if len(run) == SAMPLES:
                out.append((k, run[0][0], run[-1][0], np.array([r[2] for r in run])))
                run = []
    return out


def slow_row(x, spec):
    y = x if not spec.band else stop(x, spec.band)
    q = np.quantile(y, [0.25, 0.5, 0.75])
    y = (y - y.mean()) / max(y.std(), 1e-12) if spec.scale == "zscore" else (y - q[1]) / max(q[2] - q[0], 1e-12) if spec.scale == "robust" else y
    power = [abs(sum(v * np.exp(-2j * np.pi * k * i / SAMPLES) for i, v in enumerate(y))) ** 2 for k in range(SAMPLES // 2 + 1)]
    hz = [k * RATE / SAMPLES for k in range(SAMPLES // 2 + 1)]
    band = sum(p for p, f in zip(power, hz, strict=True) if 0.5 <= f <= 1.5) / sum(power[1:])
    a, b = np.quantile(x, [0.25, 0.75])
    return [y.mean(), y.std(), y.min(), y.max(), *np.quantile(y, [0.25, 0.75]), np.mean(np.diff(x) == 0), np.log1p(b - a), min(max(band, 0), 1)]


@pytest.mark.parametrize("width", [7 * SECOND, 61 * SECOND, None])
def test_windows_like_a_slow_version(spark, width):
    rng = np.random.default_rng(6)
    samples, at = [], 0
    for i in range(700):
        at += 250_000 if rng.random() > 0.01 else int(rng.choice([0, 5 * SECOND]))
        v = float(np.round(np.sin(at / SECOND * 4) + rng.normal() * 0.3, 1))
        samples.append((int(i % 350 > 300), at, i, float("inf") if i % 97 == 0 else v))
    samples += [(0, None, 800, 1.0), (0, 10, 801, None), (5, 10, 802, 1.0)]
    df = spark.createDataFrame(samples, "user_id long, s long, event_id long, value double").select("user_id", F.timestamp_micros("s").cast("timestamp_ntz").alias("ts"), "event_id", "value")
    stop_at = {0: at - 20 * SECOND, 1: at}
    stops = spark.createDataFrame(list(stop_at.items()), "user_id long, s long").select("user_id", F.timestamp_micros("s").cast("timestamp_ntz").alias("stop_at"))
    windows = conditioning.signal_windows(df, "user_id", SAMPLES, SECOND, stops=stops, width=width)
    want = slow_windows(samples, SECOND, stop_at)
    assert len(want) > 10
    got = sorted(windows.collect())
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(k, a, b, x.tolist()) for k, a, b, x in sorted(want, key=lambda w: w[:3])]
    rows = {(r["user_id"], r["window_start"], r["conditioning"]): [r[c] for c in conditioning.STATISTICS] for r in conditioning.conditioned(windows, "user_id", RATE, SPECS, (0.5, 1.5)).collect()}
    assert len(rows) == 3 * len(want)
    for k, a, _, x in want:
        for spec in SPECS:
            assert np.allclose(rows[k, a, spec.name], slow_row(x, spec), atol=1e-8)


def test_the_query_reads_its_table(spark):
    got = catalogue.queries()["n12_signal_windows"](spark, "/root/testdata/sf0.01").collect()
    assert {r["conditioning"] for r in got} == {s.name for s in kernels.SPECS} and len(got) > 300
    assert all(abs(r["mean"]) < 1e-6 and abs(r["std"] - 1) < 1e-6 for r in got if r["conditioning"].endswith("zscore"))
