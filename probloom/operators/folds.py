"""Folds, hold-outs, resamples and generated data."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probloom.operators.ordered import running_sum
from probloom.runtime import salted_rank


def numbered(df: DataFrame, order: list[str], out: str = "row_no") -> DataFrame:
    """Row numbers from 0 in a total order."""
    return running_sum(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", out).withColumn(out, F.col(out) - 1).drop("__one")


def k_fold(df: DataFrame, order: list[str], k: int, out: str = "fold") -> DataFrame:
    """Contiguous blocks in the given order; the first n mod k folds have one row more."""
    n = df.count()
    small, extra = divmod(n, k)
    edge = extra * (small + 1)
    r = F.col("__r")
    fold = F.when(r < edge, F.floor(r / (small + 1))).otherwise(F.floor((r - edge) / max(small, 1)) + extra).cast("int")
    return numbered(df, order, "__r").withColumn(out, fold).drop("__r")


def stratified_fold(df: DataFrame, label: str, key: list[Column], k: int, out: str = "fold") -> DataFrame:
    """Every label dealt evenly over the folds."""
    return salted_rank(df, [label], key, "__r").withColumn(out, (F.col("__r") % k).cast("int")).drop("__r")


def hold_out(df: DataFrame, order: list[str], share: float) -> DataFrame:
    """``is_valid``: the first share of the rows, in order."""
    n = df.count()
    return numbered(df, order, "__r").withColumn("is_valid", F.col("__r") < math.floor(n * share)).drop("__r")


def stratified_hold_out(df: DataFrame, label: str, key: list[Column], share: float) -> DataFrame:
    """``is_test``: the share of each label's rows (rounded down), in a fixed pseudo-random order."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed(label, "__l")
    ranked = salted_rank(df, [label], key, "__r")
    return ranked.join(counts, F.col(label).eqNullSafe(F.col("__l"))).withColumn("is_test", F.col("__r") < F.floor(F.col("__n") * share)).drop("__r", "__n", "__l")


def balanced_halves(df: DataFrame, key: list[Column], out: str = "cluster", seed: int = 17) -> DataFrame:
    """Two random clusters; cluster 0 has floor(n/2) rows."""
    n = df.count()
    return salted_rank(df, [], [F.lit(seed), *key], "__r").withColumn(out, (F.col("__r") >= n // 2).cast("int")).drop("__r")


#: Families of generated features and how a column of each is drawn.
FAMILIES = {
    "normal": lambda r, n: r.normal(r.uniform(-5, 5), r.uniform(0.5, 3), n), "beta": lambda r, n: r.beta(r.uniform(0.5, 5), r.uniform(0.5, 5), n),
    "gamma": lambda r, n: r.gamma(r.uniform(1, 5), r.uniform(0.5, 2), n), "exponential": lambda r, n: r.exponential(r.uniform(0.5, 3), n),
    "gumbel": lambda r, n: r.gumbel(r.uniform(-3, 3), r.uniform(0.5, 2), n), "geometric": lambda r, n: r.geometric(r.uniform(0.2, 0.8), n),
    "poisson": lambda r, n: r.poisson(r.uniform(1, 20), n), "binomial": lambda r, n: r.binomial(10, r.uniform(0.2, 0.8), n),
    "bernoulli": lambda r, n: r.random(n) < r.uniform(0.2, 0.8), "categorical": lambda r, n: r.choice(4, n, p=r.dirichlet(np.ones(4))),
}


def generated(spark: SparkSession, rows: int, families: Sequence[str], clusters: int = 1, seed: int = 1337) -> DataFrame:
    """Independent columns of the families named; several clusters make a mixture (column ``cluster``).

    Parameters come from the seed and cluster alone, so every task draws from
    the same distributions.
    """
    names = [f"x{i}" for i in range(len(families))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = np.random.default_rng([seed, int(f["id"].iloc[0]) if len(f) else 0])
            c = own.integers(0, clusters, len(f))
            out = pd.DataFrame({"row_id": f["id"], "cluster": c.astype(np.int32)})
            for j, (name, family) in enumerate(zip(names, families)):
                v = np.zeros(len(f))
                for k in range(clusters):
                    params = np.random.RandomState((seed * 31 + j * 7 + k) % (2**31))
                    state = params.get_state()
                    draws = np.random.RandomState(own.integers(2**31))
                    fixed = _Fixed(state, draws)
                    v = np.where(c == k, np.asarray(FAMILIES[family](fixed, len(f)), float), v)
                out[name] = v
            yield out

    ddl = "row_id long, cluster int, " + ", ".join(f"{n} double" for n in names)
    return spark.range(rows).mapInPandas(run, ddl)


class _Fixed:
    """Parameters from one stream (scalars), values from another (arrays)."""

    def __init__(self, state: tuple, draws: np.random.RandomState) -> None:
        self._params = np.random.RandomState()
        self._params.set_state(state)
        self._draws = draws

    def uniform(self, a: float, b: float) -> float:
        return float(self._params.uniform(a, b))

    def dirichlet(self, alpha: np.ndarray) -> np.ndarray:
        return self._params.dirichlet(alpha)

    def random(self, n: int) -> np.ndarray:
        return self._draws.random_sample(n)

    def __getattr__(self, name: str):  # noqa: ANN204
        return getattr(self._draws, name)


def toy_shape(spark: SparkSession, shape: str, n: int, noise: float = 0.1, seed: int = 7) -> DataFrame:
    """(row_id, x, y, label) of a two-dimensional classification shape."""
    t = F.rand(seed)
    e1, e2 = F.randn(seed + 1) * noise, F.randn(seed + 2) * noise
    base = spark.range(n).withColumn("label", (F.col("id") % 2).cast("int")).withColumn("t", t)
    side, u = F.col("label"), F.col("t")
    pi = math.pi
    if shape == "two_spirals":
        r, a = F.sqrt(u) * 4, F.sqrt(u) * 3 * pi + side * pi
        x, y = r * F.cos(a), r * F.sin(a)
    elif shape == "cluster_in_cluster":
        r = F.when(side == 0, u * 1.0).otherwise(u * 0.5 + 3.0)
        a = F.rand(seed + 3) * 2 * pi
        x, y = r * F.cos(a), r * F.sin(a)
    elif shape == "moons":
        a = u * pi
        x, y = F.when(side == 0, F.cos(a)).otherwise(1.0 - F.cos(a)), F.when(side == 0, F.sin(a)).otherwise(0.5 - F.sin(a))
    elif shape == "half_kernel":
        a, r = u * pi, F.when(side == 0, F.lit(1.5)).otherwise(F.lit(3.0))
        x, y = r * F.cos(a), r * F.sin(a)
    elif shape == "corners":
        base = base.withColumn("label", (F.col("id") % 4).cast("int"))
        sx, sy = F.when(F.col("label") % 2 == 0, 1.0).otherwise(-1.0), F.when(F.col("label") < 2, 1.0).otherwise(-1.0)
        along = F.rand(seed + 3) < 0.5
        x, y = sx * (2 + F.when(along, u * 3).otherwise(F.lit(0.0))), sy * (2 + F.when(along, F.lit(0.0)).otherwise(u * 3))
    elif shape == "outlier":
        base = base.withColumn("label", F.when(F.col("id") % 20 == 0, (F.col("id") / 20 % 2).cast("int") + 2).otherwise(F.col("label")))
        x = F.when(F.col("label") < 2, F.col("label") * 4 - 2 + u).otherwise((F.col("label") * 2 - 5) * 6.0)
        y = F.when(F.col("label") < 2, F.rand(seed + 3)).otherwise((F.col("label") * 2 - 5) * 6.0)
    else:
        raise ValueError(f"unknown shape {shape!r}")
    return base.select(F.col("id").alias("row_id"), (x + e1).alias("x"), (y + e2).alias("y"), "label")


def three_node_sample(rng: np.random.Generator, types: Sequence[str], links: Sequence[int], n: int) -> np.ndarray:
    """Columns of three variables where link i ties variable i to variable i+1 (the last to the first): Gibbs-style passes."""
    x = rng.normal(size=(n, 3))
    for _ in range(5):
        for i in range(3):
            drive = links[i - 1] * x[:, i - 1] + links[i] * x[:, (i + 1) % 3]
            z = 1.5 * drive + rng.normal(size=n)
            x[:, i] = np.tanh(z / 2) * 2 if types[i] == "continuous" else np.clip(np.round(z), -3, 3) if types[i] == "discrete" else (z > 0).astype(float)
    return x
