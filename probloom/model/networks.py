"""Poisson dependency networks: every feature predicted from the others, by a log-linear model or by trees."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probloom.functions import scalar as S

#: Least probability and least mean of a count.
LEAST_P, LEAST_MEAN = 1e-6, 1e-3


class DependencyNetwork:
    """One model per column; ``kind``: glm (Poisson, log link, no intercept), tree or boosted."""

    def __init__(self, columns: Sequence[str], kind: str = "tree", depth: int = 5, trees: int = 10) -> None:
        if kind not in ("glm", "tree", "boosted"):
            raise ValueError(f"unknown kind {kind!r}")
        self.columns, self.kind, self.depth, self.trees = list(columns), kind, depth, trees
        self.models: list = []

    def fit(self, df: DataFrame) -> DependencyNetwork:
        """Fit on rows without NULLs."""
        rows = df.select(*[F.col(c).cast("double").alias(c) for c in self.columns]).dropna()
        self.models = []
        for c in self.columns:
            seen = VectorAssembler(inputCols=[o for o in self.columns if o != c], outputCol="__in").transform(rows)
            arg = {"featuresCol": "__in", "labelCol": c, "predictionCol": "__out"}
            if self.kind == "glm":
                made = GeneralizedLinearRegression(family="poisson", link="log", fitIntercept=False, maxIter=25, regParam=1e-3, **arg)
            elif self.kind == "tree":
                made = DecisionTreeRegressor(maxDepth=self.depth, seed=7, **arg)
            else:
                made = GBTRegressor(maxDepth=self.depth, maxIter=self.trees, seed=7, **arg)
            self.models.append(made.fit(seen))
        return self

    def means(self, df: DataFrame) -> DataFrame:
        """Append ``mean_<c>``, the predicted mean of every column given the others."""
        for c, m in zip(self.columns, self.models):
            seen = VectorAssembler(inputCols=[o for o in self.columns if o != c], outputCol="__in", handleInvalid="keep").transform(df)
            df = m.transform(seen).withColumn(f"mean_{c}", F.greatest(F.col("__out"), F.lit(LEAST_MEAN))).drop("__in", "__out")
        return df

    def log_likelihood(self, df: DataFrame, out: str = "ll") -> DataFrame:
        """Append the pseudo log-likelihood: the sum over columns of log Poisson given the others, floored."""
        given = df.columns
        scored = self.means(df)
        terms = [F.greatest(S.log_poisson(F.col(c).cast("double"), F.col(f"mean_{c}")), F.lit(float(np.log(LEAST_P)))) for c in self.columns]
        return scored.select(*given, S.add(terms).alias(out))

    def perplexity(self, df: DataFrame) -> DataFrame:
        """2 to the negative likelihood per counted event."""
        words = S.add([F.col(c) for c in self.columns])
        return self.log_likelihood(df).agg((F.pow(F.lit(2.0), -(F.sum("ll") / F.sum(words)))).alias("perplexity"))

    def complete(self, df: DataFrame, rounds: int = 3) -> DataFrame:
        """Fill NULLs by the rounded predicted means, starting from column means, in some rounds of passes over the columns."""
        given = df.columns
        first = df.agg(*[F.avg(c).alias(c) for c in self.columns]).first()
        gone = {f"__gone_{c}": F.col(c).isNull() for c in self.columns}
        out = df.withColumns(gone).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(first[c] or 0))) for c in self.columns})
        for _ in range(rounds):
            out = self.means(out).withColumns({c: F.when(F.col(f"__gone_{c}"), F.round(F.col(f"mean_{c}"))).otherwise(F.col(c)) for c in self.columns}).drop(*[f"mean_{c}" for c in self.columns])
        return out.select(*given)

    def size(self) -> int:
        """Coefficients or tree nodes in all."""
        return sum(len(m.coefficients) if self.kind == "glm" else m.numNodes if self.kind == "tree" else m.totalNumNodes for m in self.models)


def mixture_assigner(x: np.ndarray, features: Sequence[int], k: int, rng: np.random.Generator, rounds: int = 8) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Clusters by hard EM over log-linear Poisson networks, fitted on a small sample."""
    label = rng.integers(0, k, len(x))
    d = x.shape[1]
    x = np.maximum(x, 0)
    z = np.log1p(x)

    def score(x: np.ndarray, z: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), k))
        for j in range(k):
            m = np.exp(np.clip(np.hstack([z, np.ones((len(z), 1))]) @ full[j].T, -10, 10))
            out[:, j] = (x * np.log(np.maximum(m, LEAST_MEAN)) - m).sum(1)
        return out

    full = np.zeros((k, d, d + 1))
    for _ in range(rounds):
        for j in range(k):
            own = label == j
            if own.sum() < 2:
                own = rng.random(len(x)) < 0.5
            a = np.hstack([z[own], np.ones((int(own.sum()), 1))])
            for f in range(d):
                keep = [i for i in range(d + 1) if i != f]
                w = np.linalg.lstsq(a[:, keep].T @ a[:, keep] + np.eye(d) * 1e-3, a[:, keep].T @ z[own, f], rcond=None)[0]
                full[j, f] = 0
                full[j, f, keep] = w
        new = score(x, z).argmax(1)
        if (new == label).all():
            break
        label = new
    fs = list(features)
    return lambda rows, h: score(np.maximum(rows[:, fs], 0), np.log1p(np.maximum(rows[:, fs], 0))).argmax(1)
