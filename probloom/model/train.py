"""Learning the weights and leaf parameters of a given structure.

Expectation-maximisation sums expected counts over all rows each round;
gradient ascent (Adam) sums gradients the same way. Both touch the driver with
numbers of the model's size only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probloom.model import nodes as N
from probloom.model.leaves import Bernoulli, Gaussian, Leaf, Poisson
from probloom.model.nodes import Node, Product, Sum
from probloom.model.score import matrix


def _expectations(root: Node, x: np.ndarray) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
    """Log-likelihood, expected child counts of each sum, and (count, sum, sum of squares) of each leaf, in walking order."""
    value: dict[int, np.ndarray] = {}

    def up(n: Node) -> np.ndarray:
        if isinstance(n, Leaf):
            v = x[:, n.feature]
            out = np.zeros(len(v))
            seen = ~np.isnan(v)
            out[seen] = n.numpy(v[seen])
        else:
            parts = np.stack([up(c) for c in n.children])
            if isinstance(n, Product):
                out = parts.sum(0)
            else:
                parts = parts + np.array(n.log_weights)[:, None]
                top = parts.max(0)
                out = top + np.log(np.exp(parts - top).sum(0))
        value[id(n)] = out
        return out

    ll = up(root)
    sums: list[np.ndarray] = []
    stats: list[np.ndarray] = []
    flow = [(root, np.ones(len(x)))]
    for n, w in flow:  # breadth first, as nodes.walk
        if isinstance(n, Leaf):
            v = np.nan_to_num(x[:, n.feature])
            u = np.where(np.isnan(x[:, n.feature]), 0, w)
            stats.append(np.array([u.sum(), (u * v).sum(), (u * v * v).sum()]))
        elif isinstance(n, Product):
            flow += [(c, w) for c in n.children]
        else:
            post = [w * np.exp(value[id(c)] + lw - value[id(n)]) for c, lw in zip(n.children, n.log_weights)]
            sums.append(np.array([p.sum() for p in post]))
            flow += list(zip(n.children, post))
    return float(ll.sum()), sums, stats


def _totals(df: DataFrame, columns: list[str], root: Node) -> tuple[float, float, np.ndarray]:
    """Rows, log-likelihood and all expected counts over the whole table."""
    held = df.sparkSession.sparkContext.broadcast(root)
    d = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            ll, sums, stats = _expectations(held.value, matrix(b, d))
            v = np.concatenate([[b.num_rows, ll], *sums, *stats])
            total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    v = df.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
    return v[0], v[1], v[2:]


def _cut(root: Node, v: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    sums, stats, at = [], [], 0
    for n in N.walk(root):
        if isinstance(n, Sum):
            sums.append(v[at : at + len(n.weights)])
            at += len(n.weights)
    for n in N.walk(root):
        if isinstance(n, Leaf):
            stats.append(v[at : at + 3])
            at += 3
    return sums, stats


def _rebuilt(root: Node, weights: list[tuple[float, ...]], fitted: list[Leaf]) -> Node:
    order = list(N.walk(root))
    index = {"s": 0, "l": 0}
    plan = {}
    for k, n in enumerate(order):
        if isinstance(n, Sum):
            plan[k] = weights[index["s"]]
            index["s"] += 1
        elif isinstance(n, Leaf):
            plan[k] = fitted[index["l"]]
            index["l"] += 1
    below, at = {}, 1
    for k, n in enumerate(order):
        below[k] = list(range(at, at + len(N.children(n))))
        at += len(N.children(n))

    def build(k: int) -> Node:
        n = order[k]
        if isinstance(n, Leaf):
            return plan[k]
        kids = tuple(build(c) for c in below[k])
        return Product(kids) if isinstance(n, Product) else Sum(plan[k], kids)

    return build(0)


def em(df: DataFrame, root: Node, columns: list[str], rounds: int = 10, smoothing: float = 1e-3) -> tuple[Node, list[float]]:
    """The model after some rounds and the mean log-likelihood before each. Gaussian, Poisson and Bernoulli leaves are refitted, others kept."""
    history = []
    for _ in range(rounds):
        n, ll, v = _totals(df, columns, root)
        history.append(ll / max(n, 1))
        sums, stats = _cut(root, v)
        weights = [tuple(float(x) for x in (s + smoothing) / (s + smoothing).sum()) for s in sums]
        fitted: list[Leaf] = []
        for leaf, (w, s, q) in zip([x for x in N.walk(root) if isinstance(x, Leaf)], stats):
            if w <= 1e-9:
                fitted.append(leaf)
                continue
            m = s / w
            if isinstance(leaf, Gaussian):
                leaf = Gaussian(leaf.feature, m, max(float(np.sqrt(max(q / w - m * m, 0))), 1e-3))
            elif isinstance(leaf, Poisson):
                leaf = Poisson(leaf.feature, max(m, 1e-15))
            elif isinstance(leaf, Bernoulli):
                leaf = Bernoulli(leaf.feature, min(max(m, 1e-6), 1 - 1e-6))
            fitted.append(leaf)
        root = _rebuilt(root, weights, fitted)
    return root, history


def _free(leaf: Leaf) -> np.ndarray:
    """A leaf's parameters on an unbounded scale; none where its family has no gradient here."""
    if isinstance(leaf, Gaussian):
        return np.array([leaf.mu, np.log(leaf.sd)])
    if isinstance(leaf, Poisson):
        return np.array([np.log(leaf.rate)])
    if isinstance(leaf, Bernoulli):
        return np.array([np.log(leaf.p / (1 - leaf.p)) if 0 < leaf.p < 1 else np.sign(leaf.p - 0.5) * 15.0])
    return np.zeros(0)


def _leaf_at(leaf: Leaf, free: np.ndarray) -> Leaf:
    if isinstance(leaf, Gaussian):
        return Gaussian(leaf.feature, float(free[0]), max(float(np.exp(free[1])), 1e-3))
    if isinstance(leaf, Poisson):
        return Poisson(leaf.feature, float(np.exp(np.clip(free[0], -30, 30))))
    if isinstance(leaf, Bernoulli):
        return Bernoulli(leaf.feature, float(1 / (1 + np.exp(-np.clip(free[0], -30, 30)))))
    return leaf


def _leaf_gradient(leaf: Leaf, stats: np.ndarray) -> np.ndarray:
    """Gradient by the free parameters from (count, sum, sum of squares); that of a mean in its deviations."""
    w, x, q = stats
    if isinstance(leaf, Gaussian):
        m, sd = leaf.mu, leaf.sd
        return np.array([(x - m * w) / sd, (q - 2 * m * x + m * m * w) / (sd * sd) - w])
    if isinstance(leaf, Poisson):
        return np.array([x - leaf.rate * w])
    if isinstance(leaf, Bernoulli):
        return np.array([x - leaf.p * w])
    return np.zeros(0)


def adam(df: DataFrame, root: Node, columns: list[str], rounds: int = 50, rate: float = 0.1, label: int | None = None, leaves: bool = True) -> tuple[Node, list[float]]:
    """Gradient ascent on the sums' weights and, with ``leaves``, on Gaussian, Poisson and Bernoulli leaves.

    The objective is log p, with ``label`` log p(label | rest). Returns the
    model and the mean objective before each round.
    """
    logits = [np.log(np.maximum(n.weights, 1e-12)) for n in N.walk(root) if isinstance(n, Sum)]
    fitted = [x for x in N.walk(root) if isinstance(x, Leaf)]
    free = [_free(x) if leaves else np.zeros(0) for x in fitted]
    theta = logits + free
    m, s, history = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta], []
    hidden = [F.lit(None).cast("double").alias(c) if i == label else F.col(c) for i, c in enumerate(columns)]

    def now() -> tuple[Node, list[np.ndarray]]:
        weights = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in theta[: len(logits)]]
        own = [_leaf_at(x, t) if len(t) else x for x, t in zip(fitted, theta[len(logits) :])]
        return _rebuilt(root, [tuple(map(float, w)) for w in weights], own), weights

    for t in range(1, rounds + 1):
        model, weights = now()
        own = [x for x in N.walk(model) if isinstance(x, Leaf)]
        n, ll, v = _totals(df, columns, model)

        def gradient(v: np.ndarray, model: Node = model, weights: list[np.ndarray] = weights, own: list[Leaf] = own) -> list[np.ndarray]:
            up, stats = _cut(model, v)
            return [u - w * u.sum() for u, w in zip(up, weights)] + [_leaf_gradient(x, y) if len(f) else f for x, y, f in zip(own, stats, free)]

        grad = gradient(v)
        if label is not None:
            _, other, v = _totals(df.select(*hidden), columns, model)
            ll -= other
            grad = [g - h for g, h in zip(grad, gradient(v))]
        history.append(ll / max(n, 1))
        for i, g in enumerate(grad):
            g = g / max(n, 1)
            m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.999 * s[i] + 0.001 * g * g
            step = rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
            if i >= len(logits) and isinstance(own[i - len(logits)], Gaussian) and len(step):
                step = step * np.array([own[i - len(logits)].sd, 1.0])
            theta[i] = theta[i] + step
    return now()[0], history
