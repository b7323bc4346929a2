"""Connected components of an edge table by alternating large-star and small-star rounds."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import drop, save


class Joined:
    """Which of `n` rows are connected, from blocks of a boolean matrix of pairs."""

    def __init__(self, n: int):
        self.head = np.arange(n)

    def add(self, start: int, pairs: np.ndarray) -> None:
        """pairs[i, j]: row start + i is linked with row start + j."""
        rows, columns = pairs.shape
        old = self.head[start:start + columns]
        now, most = old.copy(), len(self.head)
        while True:
            new = now.copy()
            new[:rows] = np.minimum(new[:rows], np.where(pairs, now[None, :], most).min(1))
            new = np.minimum(new, np.where(pairs, new[:rows, None], most).min(0))
            if (new == now).all():
                break
            now = new
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for a, b in {(a, b) for a, b in zip(old.tolist(), now.tolist()) if a != b}:
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if up:
            heads = np.arange(most)
            for x in up:
                heads[x] = top(x)
            self.head = heads[self.head]


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the least node of its component.

    Each round re-hangs edges on the least neighbour; minima are pre-aggregated, so a node of very many
    edges is no burden, and rounds grow with the logarithm of the longest path. Tables are written
    between rounds. Edges of a node to itself only name the node.
    """
    now = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes = save(now.select(F.col("a").alias("node")).union(now.select("b")).distinct(), "nodes")
    now, last = now.where("a != b"), None
    while (state := _state(now)) != last:
        last = state
        # large star: what is above a node hangs on the least of its neighbourhood
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = save(large, "edges")
        # small star: a node and all below it hang on the least below
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        new = save(small.where("a != b").distinct(), "edges")
        drop(now, large)
        now = new
    return nodes.join(now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")), "node", "left").select(
        "node", F.coalesce("b", "node").alias("root"))
