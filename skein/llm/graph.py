"""Connected components of an edge table, for operators that group documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a long, b long): root is the least node of its component.

    Alternating large-star and small-star steps: the edge count never grows, and a component of n
    nodes settles in O(log n) rounds. A node's least neighbour is a combined minimum that is joined
    back, so the edges of a hub are never one task's: the join splits them. Every round is written to
    the shared folder, so a lost executor costs one round at most. Null ends and loops are left out.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _digest(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.join(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "a")
        large = stored(low.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "edges")
        low = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = low.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        spent, e = [e, large], stored(small.where("a <> b").distinct(), "edges")
        for x in spent:
            discard(x)
        now = _digest(e)
        if before == now:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _digest(e: DataFrame) -> tuple:
    """(number of edges, a sum of their hashes): equal for equal edge tables."""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least row of its component, so far) after the edges a-b."""
    while len(a):
        x, y = label[a], label[b]
        on = x != y
        if not on.any():
            break
        a, b, x, y = a[on], b[on], x[on], y[on]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label
