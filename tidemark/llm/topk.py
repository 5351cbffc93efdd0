"""Exact top-k inner products: tiles of queries and shards, partial selection in each, a tree of merges.

Candidates are dealt into shards and queries into blocks, both of bounded size and by hash, so that no tile grows
with the table. A vector is shuffled once per block of queries, so blocks are as large as a task can hold (32,768 rows);
within a tile queries go 256 at a time. Each (block, shard) pair is one tile: a matrix product in doubles, exact because a tile checks that
no sum can reach 2^53 (a tile that could goes through Python integers instead). A tile keeps its k best a query; the
lists of 16 shards are merged at a time until one is left.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part; a shorter vector counts
as padded with zeros; rows whose vec_id is null take no part; a candidate with the query's own vec_id is left out,
and of queries that share a vec_id each row with another vector gives its own list, so repeated equal ones appear
once; scores beyond long are held at its bounds; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

FOUND = "query_id long, q_key long, vec_id long, score long, shard int"


def integer_vectors(table: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component as doubles, for the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    return rows.where(usable).select("vec_id", F.transform("embedding", lambda c: F.floor(c * scale).cast("double")).alias("v"))


def tile_best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of the query, column of the candidate) of each query's k best, ties to the smaller id; c_ids ascend."""
    top = max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0)) * q.shape[1]
    scores = q @ c.T if top < 2**53 else np.array(q.astype(object).dot(c.astype(object).T), dtype=object)
    rows, cols = [], []
    for i in range(len(q_ids)):
        own = c_ids != q_ids[i]
        at = np.flatnonzero(own)
        s = scores[i][at]
        if len(at) > k:
            if s.dtype == object:
                edge = sorted(s, reverse=True)[k - 1]
            else:
                edge = np.partition(s, len(s) - k)[len(s) - k]
            above, equal = at[s > edge], at[s == edge]
            at = np.concatenate([above, equal[: k - len(above)]])
        rows.append(np.full(len(at), i))
        cols.append(at)
    r, cc = np.concatenate(rows) if rows else np.zeros(0, int), np.concatenate(cols) if cols else np.zeros(0, int)
    return r, cc, np.array([int(max(-(2**63), min(2**63 - 1, int(scores[i][j])))) for i, j in zip(r, cc, strict=True)], dtype=np.int64)


def _matrix(v: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(v), width))
    for i, x in enumerate(v):
        out[i, : len(x)] = x
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 16384, block_rows: int = 32768) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best among vectors (both vec_id, v)."""
    vectors, queries = stored(vectors, "vectors"), stored(queries.distinct(), "queries")
    shards = max(1, -(-vectors.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    c = vectors.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    q_key = F.xxhash64("vec_id", "v")
    q = queries.select("vec_id", "v", q_key.alias("q_key"), F.pmod(q_key, F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def tile(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "q_key": [], "vec_id": [], "score": [], "shard": []}).astype("int64")
        right = right.sort_values("vec_id", kind="stable")
        width = max(left["v"].map(len).max(), right["v"].map(len).max())
        ids, keys = left["vec_id"].to_numpy(), left["q_key"].to_numpy()
        c_ids, cm = right["vec_id"].to_numpy(), _matrix(right["v"], width)
        out = []
        for at in range(0, len(ids), 256):
            part = slice(at, at + 256)
            r, j, s = tile_best(ids[part], _matrix(left["v"].iloc[part], width), c_ids, cm, k)
            out.append(pd.DataFrame({"query_id": ids[part][r], "q_key": keys[part][r], "vec_id": c_ids[j], "score": s, "shard": key[1]}))
        return pd.concat(out, ignore_index=True)

    found = q.groupBy("block", "shard").cogroup(c.groupBy("block", "shard")).applyInPandas(tile, FOUND)
    order = [F.desc("score"), F.asc("vec_id")]
    while shards > 16:
        shards = -(-shards // 16)
        found = found.withColumn("shard", (F.col("shard") / 16).cast("int"))
        some = Window.partitionBy("query_id", "q_key", "shard").orderBy(*order)
        found = found.withColumn("n", F.row_number().over(some)).where(F.col("n") <= k).drop("n")
    whole = Window.partitionBy("query_id", "q_key").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
