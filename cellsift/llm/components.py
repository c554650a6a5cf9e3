"""Connected components of edges, and forests inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cellsift.llm.common import ship, staged

ship(__name__)


class Forest:
    """Union-find over ``n`` numbers; the root of a tree is its smallest number."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def _root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        if len(left) > 1:  # most of many edges lie inside a tree already
            roots = np.array([self._root(i) for i in range(len(self.parent))])
            apart = roots[left] != roots[right]
            left, right = left[apart], right[apart]
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            x, y = self._root(a), self._root(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def edges(self) -> list[tuple[int, int]]:
        """An edge from the root of its tree to every other number of it."""
        return [(root, i) for i in range(len(self.parent)) if (root := self._root(i)) != i]


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the edges ``(a, b)``: the smallest node that can be reached.

    First every node keeps the edge to its smallest neighbour and hands its other smaller neighbours on to that one:
    many edges of a group become the same few. Then in every round a node takes the smallest label among its own and its
    neighbours', and then the label of that label, so long chains close in few rounds. Minima are aggregated before they
    are shuffled; a hub's edges are spread by the other end.
    Each round's labels are written to the shared folder.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct()
    down = staged(down, "edges")
    first = down.groupBy("x").agg(F.min("y").alias("first"))
    handed = down.join(first, "x").select(F.explode(F.array(_edge("x", "first"), _edge("y", "first"))).alias("e"))
    star = handed.select("e.x", "e.y").where("x <> y").distinct()
    both = staged(star.union(star.select(F.col("y").alias("x"), F.col("x").alias("y"))), "edges")
    labels = staged(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("label")), "labels")
    while True:
        seen = both.join(labels, F.col("x") == F.col("node")).groupBy(F.col("y").alias("node")).agg(F.min("label").alias("near"))
        near = labels.join(seen, "node", "left").select("node", "label", F.least("label", "near").alias("near"))
        far = labels.select(F.col("node").alias("_far"), F.col("label").alias("far"))
        jumped = near.join(far, F.col("near") == F.col("_far"), "left").select(
            "node", F.least("near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved")
        )
        jumped = staged(jumped, "labels")
        moved = jumped.where("moved").limit(1).count()
        labels = jumped.select("node", "label")
        if not moved:
            return labels.select("node", F.col("label").alias("component"))


def _edge(x: str, y: str) -> Column:
    return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
