"""Windows of a raw signal under several conditionings, from one scan.

Samples of an island are cut into tumbling windows of a fixed number of samples (see timeseries.tumbling), each window
becomes one array, and every conditioning of it is a row. A window is bounded by its number of samples, a key is as many
tasks as it has slices, and nothing depends on where slices end.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import signals
from .sequences import micros
from .timeseries import tumbling


class Spec(NamedTuple):
    """A conditioning: a band in hertz (None: the samples as they are) and a scale (none, zscore or robust)."""

    name: str
    band: tuple[float, float] | None = None
    scale: str = "none"

    def of(self, values: Column, rate: float) -> Column:
        if self.band:
            return signals.band_pass(values, rate, *self.band, scale=self.scale)
        return {"none": lambda v: v, "zscore": signals.z_scores, "robust": signals.robust_scores}[self.scale](values)


STATISTICS = ["mean", "std", "min", "max", "q25", "q75", "flat_fraction", "log_iqr", "band_ratio"]


def signal_windows(df: DataFrame, key: str, samples: int, max_gap: int, value: str = "value", ts: str = "ts", tie: str = "event_id", stops: DataFrame | None = None, width: int | None = None) -> DataFrame:
    """key, window_start, window_end, x: the samples of each whole window in order.

    Samples without a time or a finite value are left out first. stops (key, stop_at): a key is read up to that time and
    never past it; a key without one is not read.
    """
    fit = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")) & F.col(ts).isNotNull()
    rows = df.where(fit).select(key, ts, tie, F.col(value).cast("double").alias(value))
    if stops is not None:
        rows = rows.join(stops.select(key, "stop_at"), key).where(F.col(ts) <= F.col("stop_at")).drop("stop_at")
    blocks = tumbling(rows, key, samples, max_gap, ts, tie, width)
    sample = F.struct(micros(ts).alias("t"), F.col(tie).alias("tie"), F.col(value).alias("v"))
    found = blocks.groupBy(key, "island", "block").agg(F.sort_array(F.collect_list(sample)).alias("s"))
    return found.select(key, F.get("s", F.lit(0))["t"].alias("window_start"), F.get("s", F.lit(samples - 1))["t"].alias("window_end"), F.transform("s", lambda r: r["v"]).alias("x"))


def conditioned(windows: DataFrame, key: str, rate: float, specs: list[Spec], pulse: tuple[float, float] = (0.5, 8.0)) -> DataFrame:
    """key, window_start, window_end, conditioning and nine statistics of each window under each spec.

    Flat share and amplitude are those of the raw samples; the others are of the conditioned ones.
    """
    raw = signals.moments("x")
    rows = windows.withColumns({"flat_fraction": raw["flat_share"], "log_iqr": F.log1p(raw["q75"] - raw["q25"])})
    each = F.explode(F.array(*(F.struct(F.lit(s.name).alias("conditioning"), s.of(F.col("x"), rate).alias("y")) for s in specs)))
    rows = rows.select(key, "window_start", "window_end", "flat_fraction", "log_iqr", each.alias("c")).select("*", "c.*")
    band = signals.band("y", rate, pulse, (1e-9, rate / 2), detrend=False)["ratio"]  # the mean does not count
    rows = rows.withColumns({"m": signals.moments("y"), "band_ratio": band})
    share = F.least(F.greatest(F.coalesce("band_ratio", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    own = [F.col("m")[c].alias(c) for c in STATISTICS[:6]]
    return rows.select(key, "window_start", "window_end", "conditioning", *own, "flat_fraction", "log_iqr", share.alias("band_ratio"))
