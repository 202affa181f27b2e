"""Connected components over an edge table, by alternating star contractions.

Every step is a grouped minimum (combined before the shuffle) and an equi-join,
so a hub with a third of all edges is split like any skewed join key. The
number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.llm.common import cut


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Links each neighbour of a node to the least node of its neighbourhood.

    edges has rows (a, b) with a > b. larger: the neighbours above the node,
    seen from both ends; else the neighbours below it, and the node itself.
    """
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a > b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a long, b long); component is the least node.

    Self-links and repeated edges are ignored; an empty table gives an empty
    result. Nodes without an edge have no row.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges)
    before = _state(edges)
    while before[0]:
        edges = cut(_stars(_stars(edges, True), False))
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


class Forest:
    """Disjoint sets of 0 .. n-1 inside one task."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            higher = up[up]
            if (higher == up).all():
                return up
            up[:] = higher
