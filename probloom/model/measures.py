"""Information measures of a model: entropy, mutual information, moments.

Discrete features are summed over their values, continuous ones by a midpoint
rule over their domain. Pairs of features are independent tasks: the model is
broadcast and each pair's grid is evaluated in numpy where the pair lies.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from probloom.model import nodes as N
from probloom.model.leaves import Leaf
from probloom.model.nodes import Node, Product
from probloom.model.score import evaluate

#: Points of the midpoint rule.
POINTS = 200


def support(kind: str, lo: float, hi: float, points: int = POINTS) -> tuple[np.ndarray, float]:
    """Values of a feature and the width that each stands for."""
    if kind == "continuous":
        w = (hi - lo) / points
        return lo + w * (np.arange(points) + 0.5), w
    return np.arange(lo, hi + 1), 1.0


Axis = tuple[np.ndarray, float]


def grid_probabilities(root: Node, features: Sequence[int], axes: Sequence[Axis], width: int) -> np.ndarray:
    """Probability mass of every cell of the grid over some features."""
    model = N.marginal(root, set(features)) if root.scope != frozenset(features) else root
    mesh = np.meshgrid(*[a for a, _ in axes], indexing="ij")
    x = np.full((mesh[0].size, width), np.nan)
    for f, m in zip(features, mesh):
        x[:, f] = m.ravel()
    mass = np.exp(evaluate(model, x)) * math.prod(w for _, w in axes)
    return mass.reshape(mesh[0].shape)


def density(root: Node, features: Sequence[int], width: int) -> Callable[[np.ndarray], np.ndarray]:
    """The joint density of some features as a function of a matrix of their values."""
    model = N.marginal(root, set(features))

    def run(v: np.ndarray) -> np.ndarray:
        x = np.full((len(v), width), np.nan)
        x[:, list(features)] = v
        return np.exp(evaluate(model, x))

    return run


def _xlog2(p: np.ndarray) -> float:
    q = p[p > 0]
    return float(-(q * np.log2(q)).sum())


def entropy(p: np.ndarray, widths: float = 1.0) -> float:
    """Entropy in bits; for continuous axes differential, as masses are divided by the cell's width."""
    return _xlog2(p) + float(p.sum()) * math.log2(widths)


def pair_measures(p: np.ndarray, a: Axis, b: Axis) -> dict[str, float]:
    """All measures of two features from their joint masses."""
    px, py = p.sum(1), p.sum(0)
    hx, hy, hxy = entropy(px, a[1]), entropy(py, b[1]), entropy(p, a[1] * b[1])
    mi = max(hx + hy - hxy, 0.0)
    ex, ey, exy = float(px @ a[0]), float(py @ b[0]), float(a[0] @ p @ b[0])
    d = hx + hy - 2 * mi
    return {
        "entropy_x": hx, "entropy_y": hy, "joint_entropy": hxy, "mi": mi, "nmi": mi / math.sqrt(hx * hy) if hx * hy > 0 else 0.0, "distance": d,
        "normalised_distance": d / hxy if hxy else 0.0, "mean_x": ex, "mean_y": ey, "cross_moment": exy, "covariance": exy - ex * ey,
    }


MEASURES = "entropy_x entropy_y joint_entropy mi nmi distance normalised_distance mean_x mean_y cross_moment covariance".split()


def all_pairs(spark: SparkSession, root: Node, axes: dict[int, Axis], width: int) -> DataFrame:
    """(i, j, measures..) of every pair of features."""
    held = spark.sparkContext.broadcast((root, axes))
    pairs = spark.createDataFrame(list(combinations(sorted(axes), 2)) or [(-1, -1)], "i int, j int")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, axes = held.value
        for f in frames:
            out = [{"i": i, "j": j, **pair_measures(grid_probabilities(model, [i, j], [axes[i], axes[j]], width), axes[i], axes[j])} for i, j in zip(f["i"], f["j"]) if i >= 0]
            yield pd.DataFrame(out, columns=["i", "j", *MEASURES])

    return pairs.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "i int, j int, " + ", ".join(f"{m} double" for m in MEASURES))


def informative_features(root: Node, names: Sequence[str], least: float = 1.0, together: int = 4) -> list[tuple[int, list[str]]]:
    """(number of the product in walking order, names) of the products below which at least ``together`` features have their mode at ``least`` or more."""
    out = []
    for i, n in enumerate(x for x in N.walk(root) if isinstance(x, Product)):
        found = sorted({names[leaf.feature] for leaf in N.walk(n) if isinstance(leaf, Leaf) and leaf.mode()[0] >= least})
        if len(found) >= together:
            out.append((i, found))
    return out
