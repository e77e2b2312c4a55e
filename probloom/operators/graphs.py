"""Graphs of features (small, on the driver) and of rows (distributed)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probloom.runtime import stored


def components(n: int, edges: Iterable[tuple[int, int]]) -> list[int]:
    """Component numbers of 0..n-1, from 1, in the order of their first member."""
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in edges:
        up[max(top(a), top(b))] = min(top(a), top(b))
    number: dict[int, int] = {}
    return [number.setdefault(top(i), len(number) + 1) for i in range(n)]


def above(scores: np.ndarray, threshold: float) -> list[int]:
    """Components of the features whose dependence reaches the threshold in either direction; NaN is no dependence."""
    s = np.nan_to_num(np.asarray(scores, float))
    return components(len(s), [(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if max(s[i, j], s[j, i]) >= threshold])


def significant(pvalues: np.ndarray, alpha: float) -> list[int]:
    """Components where a pair is linked only if both directions are significant."""
    p = np.asarray(pvalues, float)
    return components(len(p), [(i, j) for i in range(len(p)) for j in range(i + 1, len(p)) if p[i, j] <= alpha and p[j, i] <= alpha])


def two_bins(sizes: Mapping[int, int]) -> dict[int, int]:
    """Components to two sides, the largest first to the smaller side."""
    load, out = [0, 0], {}
    for c, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        side = int(load[1] < load[0])
        out[c] = side
        load[side] += n
    return out


def two_way_cut(scores: np.ndarray, least_share: float = 0.3) -> list[int]:
    """Two sides by components of the graph above its median score, raising the threshold while a side is below its share."""
    s = np.nan_to_num(np.maximum(scores, np.transpose(scores)))
    n = len(s)
    values = np.sort(s[np.triu_indices(n, 1)])
    best: list[int] = [0] * n
    for q in np.linspace(0.5, 1.0, 11):
        if not len(values):
            break
        labels = above(s, float(np.quantile(values, q)) + 1e-12)
        sizes = {c: labels.count(c) for c in set(labels)}
        side = two_bins(sizes)
        best = [side[c] for c in labels]
        if min(best.count(0), best.count(1)) >= least_share * n:
            return best
    return best


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of each component, for graphs of any size.

    Each round every node takes the least label around it and then its label's
    label, so a path shortens geometrically; rounds are written to the shared
    folder. Isolated nodes don't appear.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).select(F.col("a").alias("node"), "c"), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        low = label.join(near, F.col("node") == F.col("a")).select("node", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = low.join(label.select(F.col("node").alias("n2"), F.col("c").alias("c2")), F.col("c") == F.col("n2"))
        nxt = stored(jump.select("node", "old", F.least("c", "c2").alias("c")), "labels")
        if nxt.where("c <> old").isEmpty():
            return nxt.select("node", F.col("c").alias("component"))
        label = nxt.select("node", "c")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes by kind and edges of a model kept as tables."""
    kinds = nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(edges.agg(F.lit("edges").alias("kind"), F.count(F.lit(1)).alias("n")))


def dependency_graphs(kinds: Sequence[str] = ("continuous", "discrete", "categorical")) -> list[dict]:
    """All three-node graphs: type of each node times the state of each link (0 none, 1 from the first node, 2 from the second)."""
    from itertools import product

    return [{"types": t, "links": links} for t in product(kinds, repeat=3) for links in product((0, 1, 2), repeat=3)]
