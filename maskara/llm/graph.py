"""Connected components of a link table, without a driver-side graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .store import cut


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For the nodes 0..n-1 and the links a-b, the smallest node that each one reaches."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def components(links: DataFrame) -> DataFrame:
    """Links (a, b), longs in either order -> (node, root): root is the smallest node that node reaches.

    Alternates large-star and small-star steps, each two aggregations and a join by key; minima are combined before
    they are shuffled, so a hub costs its neighbours' rows but no task gathers them. Ends when a round changes
    nothing. Nodes without a link, and links of a node to itself, give no row.
    """
    now = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())

    def state(edges: DataFrame):
        return edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()

    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        next_ = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        now = cut(next_)
        after = state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
