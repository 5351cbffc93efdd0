"""A Bloom filter of keys, of one size whatever their number: it spares most other rows a shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 26  # 2^26 bits, 8 MB


def filter_of(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A predicate that holds for every key of `keys`, and for few others while they are fewer than some 2^23."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << WIDTH))
    at = place(F.col(key))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int"))
    got = keys.groupBy(F.shiftright(at, 5).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    bits = np.zeros(1 << (WIDTH - 5), dtype=np.uint32)
    bits[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    shared = keys.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def may_hold(places: pd.Series) -> pd.Series:
        x = places.to_numpy()
        return pd.Series((shared.value[x >> 5] >> (x & 31).astype(np.uint32)) & 1 == 1)

    return lambda c: may_hold(place(c))
