"""Connected components of a graph given as edges, by alternating star contractions.

A large-star step links every larger neighbour of a node to the least node in its neighbourhood, a small-star step does so for
the smaller ones.  Both keep connectivity, never make more edges than there were, and end with stars whose
centres are the least ids.  Every round is written to the shared folder, so lineage stays short, and takes the place of the one
before; nothing is collected but two sums a round.  A centre with very many leaves is the hot key of a join that stands below
a shuffle of its own, so adaptive execution splits it where its partition is large.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import discard, written


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least number in the component of each of the numbers 0 to n - 1."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        if not apart.any():
            break
        left, right, low, high = left[apart], right[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).filter("a <> b").distinct()


def components(edges: DataFrame, label: str) -> DataFrame:
    """node, component_id (the least node reachable) for every node of edges (a, b)."""
    now = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), f"{label}-edges")
    seen = None
    while True:
        before, now = now, written(_small_star(_large_star(now)), f"{label}-stars")
        discard(before)
        check = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if check == seen or check[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component_id")).union(now.select("b", "b").distinct())
        seen = check
