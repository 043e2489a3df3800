"""Connected components of an edge table by union-find in tasks and alternating star steps between them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


class UnionFind:
    """Sets of hashable items; the root of a set is its least item."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x], x = root, up
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of each batch as stars: as many as it joins nodes, whatever number of edges came in."""
    for batch in batches:
        sets = UnionFind()
        for a, b in zip(batch.a.tolist(), batch.b.tolist()):
            sets.union(a, b)
        nodes = list(sets.parent)
        yield pd.DataFrame({"a": nodes, "b": [sets.find(x) for x in nodes]}, dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a long, b long); root is the least node of the component.

    Two star steps a round (each node links its larger, then its smaller neighbours to the least one) until the
    edges stay as they are; each round is written to the shared folder. Rows never outnumber twice the edges.
    """
    edges = stage(edges.where("a != b").mapInPandas(_forest, "a long, b long").where("a != b").distinct(), "edges")
    seen = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).where("a != b").distinct()
        edges = stage(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select("b", "b").distinct())
