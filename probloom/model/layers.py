"""Models as layers of arrays: the same values, evaluated level by level with matrix operations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from probloom.model import nodes as N
from probloom.model.leaves import Leaf
from probloom.model.nodes import Node, Product, Sum
from probloom.model.score import arrow_rows

#: Nodes of one layer; wider levels become several layers.
MAX_LAYER = 100


@dataclass
class Layer:
    """Nodes of one kind on one level. ``places``: positions of their values; ``links``: (row of the layer, place below, log-weight)."""

    kind: str
    places: list[int]
    links: list[tuple[int, int, float]]
    leaves: list[Leaf]


@dataclass
class LayeredModel:
    layers: list[Layer]
    size: int
    root: int

    def value(self, x: np.ndarray) -> np.ndarray:
        """Log-likelihood of rows; NaN cells are integrated out."""
        out = np.zeros((len(x), self.size))
        for layer in self.layers:
            if layer.kind == "leaf":
                for p, leaf in zip(layer.places, layer.leaves):
                    v = x[:, leaf.feature]
                    seen = ~np.isnan(v)
                    out[seen, p] = leaf.numpy(v[seen])
                continue
            n = len(layer.places)
            below = sorted({c for _, c, _ in layer.links})
            at = {c: i for i, c in enumerate(below)}
            if layer.kind == "product":
                m = np.zeros((len(below), n))
                for r, c, _ in layer.links:
                    m[at[c], r] += 1
                out[:, layer.places] = out[:, below] @ m
            else:
                w = np.full((len(below), n), -np.inf)
                for r, c, lw in layer.links:
                    w[at[c], r] = np.logaddexp(w[at[c], r], lw)
                t = out[:, below][:, :, None] + w[None]
                top = t.max(1)
                out[:, layer.places] = top + np.log(np.exp(t - top[:, None]).sum(1))
        return out[:, self.root]

    def parameters(self) -> int:
        """Free numbers: weights of sums and fields of leaves."""
        import dataclasses

        sums = sum(len(x.links) for x in self.layers if x.kind == "sum")
        return sums + sum(sum(len(v) if isinstance(v, tuple) else 1 for k, v in dataclasses.asdict(leaf).items() if k != "feature") for x in self.layers for leaf in x.leaves)


def to_layers(root: Node, most: int = MAX_LAYER) -> LayeredModel:
    """Levels by the longest way to a leaf; nodes of a level and kind share layers of at most ``most``."""
    place: dict[int, int] = {}
    level: dict[int, int] = {}
    order: list[Node] = []

    def visit(n: Node) -> int:
        if id(n) not in level:
            level[id(n)] = 0 if isinstance(n, Leaf) else 1 + max(visit(c) for c in n.children)
            place[id(n)] = len(order)
            order.append(n)
        return level[id(n)]

    visit(root)
    layers = []
    for depth in range(max(level.values()) + 1):
        for kind, cls in (("leaf", Leaf), ("product", Product), ("sum", Sum)):
            members = [n for n in order if level[id(n)] == depth and isinstance(n, cls)]
            for at in range(0, len(members), most):
                some = members[at : at + most]
                links = [(r, place[id(c)], n.log_weights[i] if isinstance(n, Sum) else 0.0) for r, n in enumerate(some) for i, c in enumerate(N.children(n))]
                layers.append(Layer(kind, [place[id(n)] for n in some], links, some if kind == "leaf" else []))
    return LayeredModel(layers, len(order), place[id(root)])


def validate(model: LayeredModel) -> None:
    """Every layer only reads places that an earlier layer has written, and sums' weights add up to 1."""
    done: set[int] = set()
    for layer in model.layers:
        if any(c not in done for _, c, _ in layer.links):
            raise ValueError("a layer reads a value that isn't there yet")
        if layer.kind == "sum":
            for r in range(len(layer.places)):
                if abs(sum(np.exp(w) for q, _, w in layer.links if q == r) - 1) > 1e-6:
                    raise ValueError("weights of a sum don't add up to 1")
        done |= set(layer.places)


def log_likelihood(df: DataFrame, model: LayeredModel, columns: list[str], out: str = "ll") -> DataFrame:
    """Append the log-likelihood of every row, batch by batch."""
    return arrow_rows(df, columns, f"{out} double", lambda x, _: {out: model.value(x)})
