"""Continuous spans of a stream: open spans of keys are state between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def span_stream(stream: DataFrame, key: str, max_gap: int, delay: str = "1 hour", ts: str = "ts", buckets: int = 4096) -> DataFrame:
    """key, span_start, span_end (microseconds), n_rows of each closed span, appended as spans close.

    A span breaks where the time since the row before is over max_gap microseconds or not positive, so a row that
    comes late breaks it; rows older than the watermark go. Rows of one micro-batch are taken in time order. An open
    span closes once the watermark is past its end by max_gap. Rows with a null time go.

    Keys are dealt into buckets by their hash, and a bucket's state is the open span of each of its keys: Python is
    called once for a bucket, not once for a key. A bucket's times of one micro-batch are held together as arrays, so
    bound these (maxFilesPerTrigger) or raise buckets, which a checkpoint fixes. Null keys have a bucket of their own.
    """

    def follow(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, starts, lasts, rows = state.get if state.exists else ([], [], [], [])
        new = [] if state.hasTimedOut else list(chunks)
        held = len(keys)
        t = np.concatenate([np.asarray(lasts, np.int64), *(c["t"].to_numpy(np.int64) for c in new)])
        owners = [c[key] for c in new]
        if k[0] < 0:  # null keys
            owners = [pd.Series([None] * len(t), dtype=object)]
        elif held:  # a column of no row would have no kind of its own
            owners.insert(0, pd.Series(keys, dtype=owners[0].dtype if owners else None))
        owner = pd.concat(owners, ignore_index=True)
        code = pd.factorize(owner, use_na_sentinel=False)[0]
        # An open span stands before its key's new rows, whatever their times, as one row at its end.
        order = np.lexsort((t, np.arange(len(t)) >= held, code))
        start, n = t.copy(), np.ones(len(t), np.int64)
        start[:held], n[:held] = starts, rows
        t, start, n, code = t[order], start[order], n[order], code[order]
        gap, turns = np.diff(t), np.diff(code) != 0
        first = np.concatenate([[0], np.flatnonzero(turns | (gap <= 0) | (gap > max_gap)) + 1])  # places where a new span begins
        end = np.append(first[1:], len(t)) - 1
        due = (t[end] + max_gap) // 1000 + 1
        still = np.append(turns, True)[end] & (due > state.getCurrentWatermarkMs())  # the last of its key and not past
        spans = pd.DataFrame({key: owner.iloc[order[first]].array, "span_start": start[first], "span_end": t[end], "n_rows": np.add.reduceat(n, first)})
        kept = spans[still]
        if len(kept):
            state.update(tuple(kept[c].tolist() for c in spans.columns))
            state.setTimeoutTimestamp(int(due[still].min()))
        elif state.exists:
            state.remove()
        yield spans[~still]

    rows = stream.where(f"{ts} IS NOT NULL").selectExpr(key, f"cast({ts} as timestamp) AS at").withWatermark("at", delay)
    kind = rows.schema[key].dataType.simpleString()
    out, kept = f"{key} {kind}, span_start long, span_end long, n_rows long", f"keys array<{kind}>, start array<long>, last array<long>, rows array<long>"
    # A null would turn all longs of its batch into doubles; its bucket tells it.
    owner = f"coalesce({key}, cast(0 as {kind})) AS {key}" if kind in ("tinyint", "smallint", "int", "bigint") else key
    timed = rows.selectExpr(owner, "at", "unix_micros(at) AS t", f"CASE WHEN {key} IS NOT NULL THEN pmod(xxhash64({key}), {buckets}) ELSE -1 END AS key_bucket")
    return timed.groupBy("key_bucket").applyInPandasWithState(follow, out, kept, "append", GroupStateTimeout.EventTimeTimeout)
