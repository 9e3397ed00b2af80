"""Connected components, locally with NumPy and over a cluster by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelloom.llm.shared import written


def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For nodes 0 to n-1 the smallest node that edges ``u``-``v`` reach."""
    label = np.arange(n)
    while len(u):
        lu, lv = label[u], label[v]
        low, high = np.minimum(lu, lv), np.maximum(lu, lv)
        apart = low != high
        if not apart.any():
            break
        u, v = u[apart], v[apart]
        np.minimum.at(label, high[apart], low[apart])
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``: root is the smallest node that is reachable.

    Large-star and small-star steps by turns (each an aggregation and a join on the node), until the edges
    are stars around the smallest nodes.  Every step is written to the shared folder, so a lost executor
    costs one step.  A hub's edges never meet in one task: its minimum is combined before the shuffle, and
    the join back is one that adaptive execution may split.  Loops and nulls are ignored.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "edges")
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written before they are joined back, so that a hub's edges can be split over tasks
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        # large star: neighbours above a node go to the node's smallest neighbour
        large = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        # small star: a node and its lower neighbours go to the smallest of them
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        new = written(small.select("x.u", "x.v").where("u <> v").distinct(), "edges")
        # stars around the smallest: no node has two parents and no parent has a parent
        checks = new.agg(F.count("*").alias("n"), F.countDistinct("u").alias("d")).first()
        if checks["n"] == checks["d"] and new.select(F.col("v").alias("u")).distinct().join(new.select("u"), "u", "left_semi").isEmpty():
            e = new
            break
        e = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
