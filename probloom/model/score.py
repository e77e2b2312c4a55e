"""Evaluating a model over a DataFrame: likelihood, conditionals, completion, sampling, classification.

Two backends. Small models become one Column expression inside whole-stage code
generation; models of more than ``EXPRESSION_TERMS`` terms (a leaf, or a knot,
bin or point of one) go through Arrow batches and numpy. Neither shuffles. NULL marks an unobserved cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probloom.functions import scalar as S
from probloom.model import nodes as N
from probloom.model.leaves import Leaf
from probloom.model.nodes import Node, Product, Sum

#: Above this the generated method is longer than the virtual machine compiles.
EXPRESSION_TERMS = 24


def expression(node: Node, columns: list[str]) -> Column:
    """Log-likelihood of a row as one Column."""
    if isinstance(node, Leaf):
        x = F.col(columns[node.feature])
        return F.when(x.isNull(), S.lit(0)).otherwise(node.column(x.cast("double")))
    parts = [expression(c, columns) for c in node.children]
    if isinstance(node, Product):
        return S.add(parts)
    return S.log_sum_exp(F.array(*[p + S.lit(w) for p, w in zip(parts, node.log_weights)]))


def staged(df: DataFrame, root: Node, columns: list[str], out: str) -> DataFrame:
    """Append the log-likelihood by plain columns, a projection for each level of sums.

    A sum needs its terms twice (the greatest, then the rest against it); as
    columns of a projection below they are worked out once, and all of it stays
    in generated code.
    """
    stages: list[dict[str, Column]] = []

    def visit(node: Node) -> tuple[Column, int]:
        if isinstance(node, Leaf):
            return expression(node, columns), 0
        parts = [visit(c) for c in node.children]
        level = max(at for _, at in parts)
        if isinstance(node, Product):
            return S.add([p for p, _ in parts]), level
        if len(parts) == 1:
            return parts[0][0] + S.lit(node.log_weights[0]), level
        while len(stages) <= level:
            stages.append({})
        names = [f"__term_{level}_{len(stages[level]) + i}" for i in range(len(parts))]
        stages[level].update({n: p + S.lit(w) for n, (p, _), w in zip(names, parts, node.log_weights)})
        top = F.greatest(*names)
        return top + F.ln(S.add([F.exp(F.col(n) - top) for n in names])), level + 1

    value, _ = visit(root)
    for s in stages:
        df = df.withColumns(s)
    return df.withColumn(out, value).drop(*[n for s in stages for n in s])


def is_small(root: Node) -> bool:
    """Whether the model is quick as one expression."""
    return sum(1 + max([len(v) for v in vars(n).values() if isinstance(v, tuple)], default=0) for n in N.walk(root) if isinstance(n, Leaf)) <= EXPRESSION_TERMS


def evaluate(node: Node, x: np.ndarray) -> np.ndarray:
    """Log-likelihood of the rows of a matrix; NaN is unobserved."""
    if isinstance(node, Leaf):
        v = x[:, node.feature]
        seen = ~np.isnan(v)
        out = np.zeros(len(v))
        out[seen] = node.numpy(v[seen])
        return out
    parts = np.stack([evaluate(c, x) for c in node.children])
    if isinstance(node, Product):
        return parts.sum(0)
    parts = parts + np.array(node.log_weights)[:, None]
    top = parts.max(0)
    return top + np.log(np.exp(parts - top).sum(0))


def matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(n)], 1) if n else np.zeros((batch.num_rows, 0))


def listed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists; NaN is NULL."""
    flat = x.ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(flat, mask=np.isnan(flat)))


def arrow_rows(df: DataFrame, columns: list[str], out: str, f: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """Append columns computed batch by batch from a float matrix; f gets it and a seed per row."""
    given = [c for c in df.columns]
    inner = df.select(*[F.col(c).cast("double").alias(f"__m{i}") for i, c in enumerate(columns)], F.xxhash64(*given).alias("__seed"), *given)
    fields = inner.drop(*[f"__m{i}" for i in range(len(columns))], "__seed").schema
    extra = [x.strip().split(" ") for x in out.split(",")]
    ddl = ", ".join(f"`{s.name}` {s.dataType.simpleString()}" for s in fields) + ", " + ", ".join(f"`{a}` {b}" for a, b in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b, len(columns))
            made = f(x, np.asarray(b.column(len(columns))))
            kept = [b.column(i) for i in range(len(columns) + 1, b.num_columns)]
            new = [made[a] if isinstance(made[a], pa.Array) else pa.array(made[a], from_pandas=True) for a, _ in extra]
            yield pa.RecordBatch.from_arrays([*kept, *new], [*given, *[a for a, _ in extra]])

    return inner.mapInArrow(run, ddl)


def log_likelihood(df: DataFrame, root: Node, columns: list[str], out: str = "ll", backend: str = "auto") -> DataFrame:
    """Append the log-likelihood of every row."""
    if backend == "expression" or (backend == "auto" and is_small(root)):
        return staged(df, root, columns, out)
    return arrow_rows(df, columns, f"{out} double", lambda x, _: {out: evaluate(root, x)})


def conditional(df: DataFrame, root: Node, columns: list[str], target: set[int], out: str = "ll") -> DataFrame:
    """Append log p(target | rest)."""
    rest = N.marginal(root, root.scope - target)
    joint = log_likelihood(df, root, columns, "__joint")
    return log_likelihood(joint, rest, columns, "__rest").withColumn(out, F.col("__joint") - F.col("__rest")).drop("__joint", "__rest")


def complete(node: Node, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most probable completion: (score, completed rows).

    One pass up keeps only the best child of every sum, one pass down reads
    modes along it. Ties go to the first child. Features outside the model stay
    NaN. The score uses the leaves' mode scores; the exact likelihood of the
    completion comes from :func:`evaluate`.
    """
    best: dict[int, np.ndarray] = {}

    def up(n: Node) -> np.ndarray:
        if isinstance(n, Leaf):
            v = x[:, n.feature]
            out = np.full(len(v), n.mode()[1])
            seen = ~np.isnan(v)
            out[seen] = n.numpy(v[seen])
            return out
        parts = np.stack([up(c) for c in n.children])
        if isinstance(n, Product):
            return parts.sum(0)
        parts = parts + np.array(n.log_weights)[:, None]
        best[id(n)] = parts.argmax(0)
        return parts.max(0)

    score, done = up(node), x.copy()

    def down(n: Node, rows: np.ndarray) -> None:
        if isinstance(n, Leaf):
            gone = rows[np.isnan(x[rows, n.feature])]
            done[gone, n.feature] = n.mode()[0]
        elif isinstance(n, Product):
            for c in n.children:
                down(c, rows)
        else:
            for i, c in enumerate(n.children):
                picked = rows[best[id(n)][rows] == i]
                if len(picked):
                    down(c, picked)

    down(node, np.arange(len(x)))
    return score, done


def most_probable(df: DataFrame, root: Node, columns: list[str]) -> DataFrame:
    """Append ``mpe_score``, ``mpe_ll`` (likelihood of the completion) and ``completion`` (array in column order)."""

    def run(x: np.ndarray, _: np.ndarray) -> dict:
        score, done = complete(root, x)
        return {"mpe_score": score, "mpe_ll": evaluate(root, done), "completion": listed(done)}

    return arrow_rows(df, columns, "mpe_score double, mpe_ll double, completion array<double>", run)


def most_probable_expression(node: Node, columns: list[str]) -> tuple[Column, dict[int, Column]]:
    """Score and completed columns of a small model as expressions; ties go to the first child."""
    if isinstance(node, Leaf):
        x = F.col(columns[node.feature]).cast("double")
        value, score = node.mode()
        return F.when(x.isNull(), S.lit(score)).otherwise(node.column(x)), {node.feature: F.coalesce(x, S.lit(value))}
    parts = [most_probable_expression(c, columns) for c in node.children]
    if isinstance(node, Product):
        return S.add([p for p, _ in parts]), {k: v for _, done in parts for k, v in done.items()}
    scores = [p + S.lit(w) for (p, _), w in zip(parts, node.log_weights)]
    top = F.greatest(*scores)
    pick: dict[int, Column] = {}
    for feature in node.scope:
        out = parts[-1][1][feature]
        for s, (_, done) in list(zip(scores, parts))[-2::-1]:
            out = F.when(s == top, done[feature]).otherwise(out)
        pick[feature] = out
    return top, pick


def draw(node: Node, x: np.ndarray, seeds: np.ndarray, soft: bool = False) -> np.ndarray:
    """Completions drawn from the model given the observed cells; ``soft``: expectations over the sums instead."""
    rng = np.random.default_rng(int(np.bitwise_xor.reduce(seeds.astype(np.int64)) & 0x7FFFFFFF) if len(seeds) else 0)
    done = x.copy()
    posterior: dict[int, np.ndarray] = {}

    def up(n: Node) -> np.ndarray:
        if isinstance(n, Leaf):
            return evaluate(n, x)
        parts = np.stack([up(c) for c in n.children])
        if isinstance(n, Product):
            return parts.sum(0)
        parts = parts + np.array(n.log_weights)[:, None]
        top = parts.max(0)
        p = np.exp(parts - top)
        posterior[id(n)] = p / p.sum(0)
        return top + np.log(p.sum(0))

    up(node)
    if soft:
        mean = np.zeros_like(x)

        def spread(n: Node, w: np.ndarray) -> None:
            if isinstance(n, Leaf):
                mean[:, n.feature] += w * n.mean()
            else:
                for i, c in enumerate(n.children):
                    spread(c, w * posterior[id(n)][i] if isinstance(n, Sum) else w)

        spread(node, np.ones(len(x)))
        for f in node.scope:
            done[:, f] = np.where(np.isnan(x[:, f]), mean[:, f], x[:, f])
        return done

    def down(n: Node, rows: np.ndarray) -> None:
        if isinstance(n, Leaf):
            gone = rows[np.isnan(x[rows, n.feature])]
            done[gone, n.feature] = n.sample(rng, len(gone))
        elif isinstance(n, Product):
            for c in n.children:
                down(c, rows)
        else:
            u = rng.random(len(rows))
            which = (posterior[id(n)][:, rows].cumsum(0) < u[None]).sum(0)
            for i, c in enumerate(n.children):
                if (which == i).any():
                    down(c, rows[which == i])

    down(node, np.arange(len(x)))
    return done


def sample(df: DataFrame, root: Node, columns: list[str], soft: bool = False) -> DataFrame:
    """Append ``sampled``: the row with unobserved cells drawn from the model (array in column order)."""
    return arrow_rows(df, columns, "sampled array<double>", lambda x, s: {"sampled": listed(draw(root, x, s, soft))})


def classify(df: DataFrame, root: Node, columns: list[str], label: int, classes: list[float]) -> DataFrame:
    """Append the class with the greatest joint likelihood; ties go to the first class."""
    if not is_small(root):

        def best(x: np.ndarray, _: np.ndarray) -> dict[str, np.ndarray]:
            asked, scores = x.copy(), []
            for c in classes:
                asked[:, label] = c
                scores.append(evaluate(root, asked))
            return {"predicted": np.array(classes, float)[np.argmax(scores, axis=0)]}

        return arrow_rows(df, columns, "predicted double", best)
    scored = df
    for i, c in enumerate(classes):
        cols = [f"__label{i}" if j == label else n for j, n in enumerate(columns)]
        scored = log_likelihood(scored.withColumn(f"__label{i}", S.lit(c)), root, cols, f"__ll{i}").drop(f"__label{i}")
    top = F.greatest(*[F.col(f"__ll{i}") for i in range(len(classes))])
    pick = S.lit(classes[-1])
    for i in range(len(classes) - 2, -1, -1):
        pick = F.when(F.col(f"__ll{i}") == top, S.lit(classes[i])).otherwise(pick)
    return scored.withColumn("predicted", pick).drop(*[f"__ll{i}" for i in range(len(classes))])
