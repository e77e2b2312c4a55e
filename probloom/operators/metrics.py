"""Scores of predictions, experiments and dependence between labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probloom.functions import scalar as S


def errors(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, Column]:
    """Mean absolute and mean squared error over rows and columns, as aggregates."""
    n = float(len(a))
    return S.add([F.avg(F.abs(x - y)) for x, y in zip(a, b)]) / n, S.add([F.avg((x - y) * (x - y)) for x, y in zip(a, b)]) / n


def likelihood_summary(column: str, by: Sequence[str], df: DataFrame) -> DataFrame:
    """Sum, mean, least and greatest log-likelihood."""
    return df.groupBy(*by).agg(F.sum(column).alias("sum_ll"), F.avg(column).alias("mean_ll"), F.min(column).alias("min_ll"), F.max(column).alias("max_ll"))


def perplexity(ll: Column, words: Column) -> Column:
    """2 to the negative log-likelihood per word, as an aggregate."""
    return F.pow(S.lit(2), -(F.sum(ll) / F.sum(words)))


def fold_summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean and population deviation over folds."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("folds"))


def best_run(df: DataFrame, valid: str, test: str, by: Sequence[str]) -> DataFrame:
    """The test score of the run with the best validation score; ties take the greater test score."""
    return df.groupBy(*by).agg(F.max(F.struct(F.col(valid).alias("v"), F.col(test).alias("t"))).alias("m")).select(*by, F.col("m.t").alias("test_of_best"))


def improvement(value: Column, base: Column) -> Column:
    """Per cent over a baseline."""
    return (value - base) / base * 100


def improvement_summary(df: DataFrame, value: str, base: str, by: Sequence[str]) -> DataFrame:
    """Mean and population deviation of the improvement over runs."""
    gain = improvement(F.col(value), F.col(base))
    return df.groupBy(*by).agg(F.avg(gain).alias("mean_gain"), F.stddev_pop(gain).alias("std_gain"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts per pair of labels, and the same over the greatest count."""
    n = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    top = n.agg(F.max("n").alias("__top"))
    return n.crossJoin(F.broadcast(top)).select(truth, predicted, "n", (F.col("n") / F.col("__top")).alias("share_of_max"))  # one row


def classification(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, and macro- and micro-averaged F1 over the labels met."""
    pairs = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.col("t").alias("label"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("real"), F.lit(0).alias("said"))
    sides = sides.unionByName(pairs.select(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("real"), F.col("n").alias("said")))
    per = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("real").alias("real"), F.sum("said").alias("said"))
    f1 = 2 * F.col("tp") / (F.col("real") + F.col("said"))
    return per.agg((F.sum("tp") / F.sum("real")).alias("accuracy"), F.avg(f1).alias("macro_f1"), (2 * F.sum("tp") / F.sum(F.col("real") + F.col("said"))).alias("micro_f1"))


def multilabel(df: DataFrame, truth: Sequence[str], predicted: Sequence[str]) -> DataFrame:
    """Exact match, 1 - Hamming loss and mean Jaccard index of 0/1 labels; no label on either side counts as 1."""
    t, p = [F.col(c) for c in truth], [F.col(c) for c in predicted]
    both = S.add([(x * y) for x, y in zip(t, p)])
    either = S.add([F.greatest(x, y) for x, y in zip(t, p)])
    same = S.add([(x == y).cast("int") for x, y in zip(t, p)])
    return df.agg(F.avg((same == len(truth)).cast("double")).alias("exact_match"), (F.avg(same) / len(truth)).alias("one_minus_hamming"), F.avg(F.when(either == 0, S.lit(1)).otherwise(both / either)).alias("jaccard"))


def multilabel_f1(df: DataFrame, truth: Sequence[str], predicted: Sequence[str]) -> DataFrame:
    """Micro- and macro-averaged F1 of 0/1 labels, from counts of each label; a label never set nor predicted has F1 0."""
    hit = [F.sum((F.col(t) * F.col(p)).cast("long")) for t, p in zip(truth, predicted)]
    both = [F.sum((F.col(t) + F.col(p)).cast("long")) for t, p in zip(truth, predicted)]
    return df.agg((2 * S.add(hit) / S.add(both)).alias("micro_f1"), (S.add([F.when(b > 0, 2 * h / b).otherwise(S.lit(0)) for h, b in zip(hit, both)]) / len(truth)).alias("macro_f1"))


def multilabel_precision(df: DataFrame, truth: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Micro- and macro-averaged average precision of 0/1 labels and their scores."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(t).alias("label"), F.col(t).cast("long").alias("y"), F.col(s).cast("double").alias("s")) for t, s in zip(truth, scores)])).alias("c")).select("c.*")
    each = [average_precision(cells.where(F.col("label") == t), "y", "s").select(F.lit("macro").alias("kind"), "average_precision") for t in truth]
    out = average_precision(cells, "y", "s").select(F.lit("micro").alias("kind"), "average_precision")
    for e in each:
        out = out.unionByName(e)
    return out.groupBy("kind").agg(F.avg("average_precision").alias("average_precision"))


def average_precision(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under precision over recall by steps; equal scores are taken together.

    One pass to counts per score, then running sums over the distinct scores.
    """
    from probloom.operators.ordered import running_sum

    per = df.where(F.col(score).isNotNull()).groupBy((-F.col(score)).alias("s")).agg(F.sum(F.col(truth).cast("long")).alias("tp"), F.count(F.lit(1)).alias("n"))
    run = running_sum(running_sum(per, ["s"], "tp", "ctp"), ["s"], "n", "cn")
    return run.agg((F.sum(F.col("tp") * F.col("ctp") / F.col("cn")) / F.sum("tp")).alias("average_precision"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """(mi, entropy_a, entropy_b, nmi) in nats of two label columns, from their counts."""
    from pyspark.sql.window import Window

    n = contingency(df.select(F.col(a).alias("a"), F.col(b).alias("b")), "a", "b")
    whole = Window.partitionBy()
    m = n.withColumn("t", F.sum("n").over(whole)).withColumn("na", F.sum("n").over(Window.partitionBy("a"))).withColumn("nb", F.sum("n").over(Window.partitionBy("b")))  # the small table of counts
    p = F.col("n") / F.col("t")
    agg = m.agg(F.sum(p * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"), (-F.sum(p * F.ln(F.col("na") / F.col("t")))).alias("entropy_a"), (-F.sum(p * F.ln(F.col("nb") / F.col("t")))).alias("entropy_b"))
    return agg.withColumn("nmi", F.when(F.col("entropy_a") * F.col("entropy_b") > 0, F.col("mi") / F.sqrt(F.col("entropy_a") * F.col("entropy_b"))).otherwise(S.lit(0)))


_LOG_FACTORIALS = np.array([math.lgamma(i + 1) for i in range(256)])


def _log_factorial(v: int | np.ndarray) -> np.ndarray:
    """Logarithm of v!, from a table or Stirling's series."""
    v = np.asarray(v, float)
    w = np.maximum(v, 1.0)
    return np.where(v < 256, _LOG_FACTORIALS[np.minimum(v, 255).astype(int)], w * np.log(w) - w + 0.5 * np.log(2 * math.pi * w) + 1 / (12 * w) - 1 / (360 * w**3))


def _expected_information(a: np.ndarray, b: np.ndarray, chunk: int = 1 << 20) -> float:
    """Mean mutual information of the tables with margins ``a`` and ``b``; margins of equal size are taken together."""
    n = float(a.sum())
    (x, nx), (y, ny) = (np.unique(v[v > 0], return_counts=True) for v in (np.asarray(a, float), np.asarray(b, float)))
    x, y, w = (np.repeat(x, len(y)), np.tile(y, len(x)), np.outer(nx, ny).ravel())
    # Overlaps farther than 40 deviations from the mean have no weight in double precision.
    mean, wide = x * y / n, 40 * np.sqrt(x * y * (n - x) * (n - y) / (n * n * max(n - 1, 1))) + 40
    lo = np.maximum(np.maximum(1, x + y - n), np.floor(mean - wide))
    size = np.maximum(np.minimum(np.minimum(x, y), np.ceil(mean + wide)) - lo + 1, 0).astype(int)
    total, at = 0.0, 0
    ends = np.cumsum(size)
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, side="right")))
        own = np.repeat(np.arange(at, to), size[at:to])
        u, v, k = x[own], y[own], lo[own] + np.arange(len(own)) - np.repeat(np.cumsum(size[at:to]) - size[at:to], size[at:to])
        p = np.exp(sum(_log_factorial(t) for t in (u, v, n - u, n - v)) - sum(_log_factorial(t) for t in (n, k, u - k, v - k, n - u - v + k)))
        total += float((w[own] * k / n * np.log(n * k / (u * v)) * p).sum())
        at = to
    return total


def adjusted_mutual_information(table: np.ndarray) -> float:
    """Mutual information of a contingency table, corrected for chance (arithmetic mean of entropies)."""
    n = table.sum()
    a, b = table.sum(1), table.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        mi = np.nansum(np.where(table > 0, table / n * np.log(n * table / np.outer(a, b)), 0))
    entropy = lambda v: -sum(x / n * math.log(x / n) for x in v if x > 0)
    expected = _expected_information(a, b)
    ha, hb = entropy(a), entropy(b)
    if ha == 0 and hb == 0:
        return 1.0
    return float((mi - expected) / (max((ha + hb) / 2, 1e-12) - expected)) if abs((ha + hb) / 2 - expected) > 1e-12 else 0.0
