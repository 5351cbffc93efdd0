"""Connected components of a graph of links, by alternating large-star and small-star steps on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import spread_join
from .storage import release, stored


def connected_components(links: DataFrame) -> DataFrame:
    """node, root of every node of links (a, b): root is the smallest node of its component.

    Each step is a groupBy and a join over edges; nothing is gathered per component, edges of a node with very many are
    dealt among tasks, and the result of each step is written to the shared folder in place of the last. The steps are logarithmic in the longest chain.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # Large star: every larger neighbour of u goes to the smallest of u and its neighbours.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = spread_join(both.where("v > u"), low, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of u, and u, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = stored(small, "edges")
        state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        before, last, edges = state(edges), edges, small
        same = state(edges) == before
        release(last)
        if same:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
