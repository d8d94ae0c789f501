"""Connected components as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge of edges(a, b); root is the smallest node of the component.

    Every round hangs each node under its smallest neighbour, follows that
    pointer once more and contracts the edges, so the edge table shrinks by a
    factor in each round and no row gathers a whole component. Null ends and
    loops are no edges. An empty table gives an empty result.
    """

    def cleaned(e: DataFrame) -> DataFrame:
        return e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()

    edges = stored(cleaned(edges.where("a is not null and b is not null")), "edges")
    rounds = []
    while True:
        ends = edges.union(edges.select("b", "a"))
        up = ends.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        up = up.join(up.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", F.col("q").alias("p"))
        up = stored(up, "parents")
        rounds.append(up)
        left = edges.join(up, "a").select(F.col("p").alias("a"), "b")
        right = left.join(up.select(F.col("a").alias("b"), "p"), "b").select("a", F.col("p").alias("b"))
        edges = stored(cleaned(right), "edges")
        if edges.isEmpty():
            break
    label = rounds[0]
    for up in rounds[1:]:
        label = label.join(up.select(F.col("a").alias("p"), F.col("p").alias("q")), "p", "left").select("a", F.coalesce("q", "p").alias("p"))
    return label.select(F.col("a").alias("node"), F.col("p").alias("root"))


class Forest:
    """Union-find over 0..n-1 inside one task; keeps the edges that joined two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.kept: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: int, b: int) -> bool:
        x, y = self.find(a), self.find(b)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        self.kept.append((a, b))
        return True
