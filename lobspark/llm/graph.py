"""Connected components by joins, every round cut by a written table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, written


def contract(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, for edges a-b among nodes 0 .. n-1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) for every node of an edge table a, b (longs).

    Alternating large-star and small-star rounds: the edges of a round are at most those of the round before,
    and their number of rounds is logarithmic in practice. Hubs are joined, not grouped: minima are aggregated
    in the map tasks first, and joined by another key than they are grouped by, so that Spark may split a hub there.
    """
    key = F.bitwise_not("u")
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(key.alias("c"), F.least("u", "m").alias("m"))
        large = both.join(low, key == F.col("c")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.select(key.alias("c"), "m"), key == F.col("c")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "small")
        drop(e)
        drop(large)
        e = small
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
