"""Tumbling windows of a stream: the unfinished window of a key is state between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_stream(stream: DataFrame, key: str, samples: int, max_gap: int, value: str = "value", delay: str = "1 hour", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """key, window_start, window_end (microseconds), x (values in order) of each whole window of `samples` rows inside a
    span, appended once it is full, with the key's rows, gaps and steps that are not positive up to its end.

    As timeseries.tumbling() of all rows, wherever the stream is cut: a span breaks where the time since the row before
    is over max_gap microseconds or not positive, and a remainder goes with it. State holds fewer than `samples` rows of
    a key; once the watermark is past a span's end by max_gap its remainder goes, and the last time and the counts stay.
    Rows of one micro-batch are taken in order of time and tie and held together by key, so bound these
    (maxFilesPerTrigger). Rows of a null time or value go, rows older than the watermark too.
    """

    def follow(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, rows, gaps, stops, times, values = state.get if state.exists else (None, 0, 0, 0, [], [])
        if state.hasTimedOut:
            state.update((last, rows, gaps, stops, [], []))
            return
        new = pd.concat(chunks).sort_values(["t", "tie"], kind="stable")
        t, v = (np.concatenate([np.asarray(a, kind), new[c].to_numpy(kind)]) for a, c, kind in ((times, "t", np.int64), (values, "v", float)))
        held = len(times)
        # Without an unfinished window the last time still tells whether the next row goes on.
        before = t[:-1] if held or last is None else np.concatenate([[last], t[:-1]])
        step = np.diff(t) if held or last is None else t - before
        lead = len(t) - len(step)  # rows that have no row before them, or whose step was counted with an earlier batch
        skip = max(held - 1, 0) if held else 0
        far, flat = step > max_gap, step <= 0
        breaks = np.flatnonzero(far | flat) + lead
        first = np.concatenate([[0], breaks[breaks > 0]])
        ends = np.append(first[1:], len(t))
        out = []
        for a, b in zip(first, ends, strict=True):
            whole = (b - a) // samples
            for i in range(whole):
                at = a + i * samples
                end = at + samples - 1
                upto = end - lead + 1  # steps up to the window's end
                out.append((k[0], int(t[at]), int(t[end]), v[at : end + 1].tolist(), rows + int(end + 1 - held), gaps + int(far[skip:upto].sum()), stops + int(flat[skip:upto].sum())))
        rest = first[-1] + (ends[-1] - first[-1]) // samples * samples
        state.update((int(t[-1]), rows + len(t) - held, gaps + int(far[skip:].sum()), stops + int(flat[skip:].sum()), t[rest:].tolist(), v[rest:].tolist()))
        if rest < len(t):
            state.setTimeoutTimestamp(max((int(t[-1]) + max_gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "window_start", "window_end", "x", "n_rows", "n_gaps", "n_not_positive"])

    rows = stream.where(f"{ts} IS NOT NULL AND {value} IS NOT NULL").selectExpr(key, f"cast({ts} as timestamp) AS at", f"cast({value} as double) AS v", f"cast({tie} as long) AS tie").withWatermark("at", delay)
    kind = rows.schema[key].dataType.simpleString()
    out = f"{key} {kind}, window_start long, window_end long, x array<double>, n_rows long, n_gaps long, n_not_positive long"
    kept = "last long, n_rows long, n_gaps long, n_not_positive long, times array<long>, v array<double>"
    timed = rows.selectExpr(key, "at", "unix_micros(at) AS t", "v", "tie")
    return timed.groupBy(key).applyInPandasWithState(follow, out, kept, "append", GroupStateTimeout.EventTimeTimeout)
