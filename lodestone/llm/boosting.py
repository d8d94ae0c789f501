"""Gradient-boosted trees over binned features, grown from sums that Spark aggregates."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Tree:
    """splits: node -> (feature, bin); rows with a bin up to that go to node 2i+1, the others to 2i+2. values: leaf -> score."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def walk(self, bins: Column, leaf, node: int = 0) -> Column:
        """leaf(i) of the leaf, or of the open node, in which the bins end."""
        if node not in self.splits:
            return leaf(node)
        feature, most = self.splits[node]
        return F.when(F.get(bins, F.lit(feature)) <= most, self.walk(bins, leaf, 2 * node + 1)).otherwise(self.walk(bins, leaf, 2 * node + 2))


@dataclass
class Boosted:
    prior: float
    trees: list[Tree] = field(default_factory=list)

    def margin(self, bins: Column) -> Column:
        total = F.lit(self.prior)
        for t in self.trees:
            total = total + t.walk(bins, lambda i, t=t: F.lit(t.values.get(i, 0.0)))
        return total

    def probability(self, bins: Column) -> Column:
        return 1 / (1 + F.exp(-self.margin(bins)))


def _best(sums: dict[tuple[int, int], tuple[float, float]], ridge: float, least: float) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split of one node; sums: (feature, bin) -> (gradient, hessian)."""
    best = None
    for f in sorted({f for f, _ in sums}):
        bins = sorted(b for g, b in sums if g == f)
        total_g, total_h = (sum(sums[f, b][i] for b in bins) for i in (0, 1))
        g = h = 0.0
        for b in bins[:-1]:
            g, h = g + sums[f, b][0], h + sums[f, b][1]
            rest_g, rest_h = total_g - g, total_h - h
            if h < least or rest_h < least:
                continue
            gain = round(g * g / (h + ridge) + rest_g * rest_g / (rest_h + ridge) - total_g * total_g / (total_h + ridge), 6)
            if gain > 1e-3 and (best is None or gain > best[0]):
                best = (gain, f, b)
    return best


def fit(table: DataFrame, rounds: int, depth: int, rate: float, ridge: float = 1.0, least: float = 0.5) -> Boosted:
    """Logistic boosting on table(bins array<int>, positive, negative): counted, different feature rows.

    A level of a tree is one aggregate, of gradients and hessians by node,
    feature and bin; only those sums reach the driver. Without rows of one
    kind the model is its prior.
    """
    n = table.agg(F.sum("positive"), F.sum("negative")).first()
    pos, neg = float(n[0] or 0), float(n[1] or 0)
    model = Boosted(math.log((pos + 0.5) / (neg + 0.5)))
    if not pos or not neg:
        return model
    for _ in range(rounds):
        p = model.probability(F.col("bins"))
        many = F.col("positive") + F.col("negative")
        graded = table.select("bins", (F.col("positive") - many * p).alias("g"), (many * p * (1 - p)).alias("h"))
        tree, open_ = Tree(), [0]
        for level in range(depth + 1):
            node = tree.walk(F.col("bins"), lambda i: F.lit(i))
            each = graded.select(node.alias("node"), "g", "h", F.posexplode("bins").alias("f", "bin")).where(F.col("node").isin(open_))
            sums: dict[int, dict] = {}
            for r in each.groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                sums.setdefault(r["node"], {})[r["f"], r["bin"]] = (round(r["g"], 9), round(r["h"], 9))
            grown = []
            for i in sorted(sums):
                g, h = (sum(v[j] for (f, _), v in sums[i].items() if f == 0) for j in (0, 1))
                tree.values[i] = round(rate * g / (h + ridge), 9)
                split = _best(sums[i], ridge, least) if level < depth else None
                if split:
                    tree.splits[i] = split[1:]
                    grown += [2 * i + 1, 2 * i + 2]
            if not grown:
                break
            open_ = grown
        model.trees.append(tree)
        if not tree.splits:
            break
    return model
