"""Histograms and the densities built from them.

Counting is one grouped aggregation over the data; everything after it works on
the small table of bins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probloom.functions import scalar as S
from probloom.model.leaves import Histogram, Isotonic, Leaf, Piecewise

#: Width of the tail that closes a continuous density, bins of the fine grid below an irregular histogram, variance of a single bin.
TAIL, FINE_BINS, NO_VARIANCE = 1e-8, 256, 1e-10


def domain_edges(lo: float, hi: float, step: float = 1.0, centred: bool = False) -> list[float]:
    """Edges of one bin per domain value lo, lo+step, ..: values in the middle or at the left."""
    n = int(math.floor((hi - lo) / step + 1e-9)) + 1
    return [lo + i * step - (step / 2 if centred else 0.0) for i in range(n + 1)]


def equal_edges(lo: float, hi: float, bins: int) -> list[float]:
    return [lo + (hi - lo) * i / bins for i in range(bins)] + [hi] if hi > lo else [lo - 0.5, lo + 0.5]


def same_binning(a: object, b: object) -> bool:
    """Whether two settings of bins agree: of one type, and equal names or numbers, or edges close to one another."""
    if type(a) is not type(b):
        return False
    return a == b if isinstance(a, (str, int)) else bool(np.shape(a) == np.shape(b) and np.allclose(a, b))


def freedman_diaconis(lo: float, hi: float, iqr: float, n: int, most: int = FINE_BINS) -> int:
    """Number of equal bins by the Freedman-Diaconis rule."""
    width = 2 * iqr / max(n, 1) ** (1 / 3)
    return max(1, min(most, math.ceil((hi - lo) / width))) if width > 0 and hi > lo else 1


def histogram(df: DataFrame, column: str, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by.., bin, lo, hi, n) with empty bins; right-open bins, the last closed; values outside count nowhere."""
    spark = df.sparkSession
    counted = df.select(*by, S.bin_index(F.col(column).cast("double"), edges).alias("bin")).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, lo double, hi double")
    if by:
        grid = df.select(*by).distinct().crossJoin(F.broadcast(grid))  # a handful of bins per group
    return grid.join(counted, [*by, "bin"], "left").select(*by, "bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def with_density(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Append count / (n * width)."""
    total = F.sum("n").over(Window.partitionBy(*by))
    return bins.withColumn("density", F.col("n") / (total * (F.col("hi") - F.col("lo"))))


def frequencies(bins: DataFrame, alpha: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Append the Laplace-smoothed share (c + alpha) / (n + bins * alpha)."""
    w = Window.partitionBy(*by)
    return bins.withColumn("freq", (F.col("n") + S.lit(alpha)) / (F.sum("n").over(w) + S.lit(alpha) * F.count(F.lit(1)).over(w)))


def averaged(bins: DataFrame, over: str) -> DataFrame:
    """Mean counts of several histograms on the same bins."""
    return bins.groupBy("bin", "lo", "hi").agg(F.avg("n").alias("n"), F.countDistinct(over).alias("histograms"))


def resampled(df: DataFrame, times: int, seed: int = 7) -> DataFrame:
    """Bootstrap resamples as Poisson(1) weights: columns ``resample`` and ``weight``; rows of weight 0 are left out.

    A weight's distribution is that of the draws with replacement of a large
    sample; no row moves between tasks.
    """
    r = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    drawn = df.withColumn("resample", r).withColumn("__u", F.pmod(F.xxhash64(*df.columns, "resample", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40))
    cumulative = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return drawn.withColumn("weight", S.add([(F.col("__u") > float(c)).cast("int") for c in cumulative])).where("weight > 0").drop("__u")


# --- densities from bins (driver side, a few hundred numbers) ----------------


def to_piecewise(edges: Sequence[float], density: Sequence[float], kind: str) -> tuple[list[float], list[float]]:
    """Points (x, y) of a piecewise-linear density of area 1.

    Continuous: bin middles, closed to 0 just outside the range; one bin is
    flat. Discrete or categorical: the bins' left edges with tails one unit wide.
    """
    e, d = list(map(float, edges)), list(map(float, density))
    if kind == "continuous":
        if len(d) > 1:
            xs, ys = [e[0] - TAIL, *[(a + b) / 2 for a, b in zip(e, e[1:])], e[-1] + TAIL], [0.0, *d, 0.0]
        else:
            xs, ys = e, [d[0], d[0]]
    else:
        xs, ys = [e[0] - 1, *e[:-1], e[-2] + 1], [0.0, *d, 0.0]
    area = float(np.trapezoid(ys, xs))
    return xs, [y / area for y in ys] if area > 0 else ys


def irregular(counts: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges and density of the penalised-likelihood histogram over a fine equal-width grid.

    Dynamic programming over all partitions of the grid into D bins maximises
    sum N ln(N / (n w)) - (D - 1) (1 + ln(B / D)) - ln(D)^2.5, which charges both
    for the number of bins and for the choice among their places. It ends where
    the charge alone outweighs what all cells together could still gain.
    """
    n, b = float(counts.sum()), len(counts)
    if n == 0 or b == 1:
        return edges[[0, -1]], np.array([1 / max(edges[-1] - edges[0], 1e-12)])
    cum = np.concatenate([[0.0], np.cumsum(counts)])
    mass, width = cum[None] - cum[:, None], edges[None] - edges[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((mass > 0) & (width > 0), mass * np.log(mass / (n * width)), np.where(width > 0, 0.0, -np.inf))
    best, back, scores = gain[0], [], [(gain[0, b], 1)]
    limit = float(gain[np.arange(b), np.arange(1, b + 1)].sum())  # every cell a bin
    for d in range(2, b + 1):
        if limit - (d - 1) * (1 + math.log(b / d)) - math.log(d) ** 2.5 <= max(scores)[0]:
            break
        total = best[:, None] + gain
        back.append(total.argmax(0))
        best = total.max(0)
        scores.append((best[b] - (d - 1) * (1 + math.log(b / d)) - math.log(d) ** 2.5, d))
    d = max(scores)[1]
    cuts, at = [b], b
    for layer in back[: d - 1][::-1]:
        at = int(layer[at])
        cuts.append(at)
    cuts = sorted({*cuts, 0})
    e = edges[cuts]
    return e, np.diff(cum[cuts]) / (n * np.diff(e))


def bayesian_blocks(counts: np.ndarray, edges: np.ndarray, p0: float = 0.05) -> np.ndarray:
    """Edges of the optimal piecewise-constant rate over a fine grid (events, prior by false-alarm rate)."""
    n = float(counts.sum())
    prior = 4 - math.log(73.53 * p0 * max(n, 1) ** -0.478)
    cum = np.concatenate([[0.0], np.cumsum(counts)])
    best, last = np.zeros(len(counts) + 1), np.zeros(len(counts) + 1, int)
    for r in range(1, len(counts) + 1):
        m, w = cum[r] - cum[:r], edges[r] - edges[:r]
        with np.errstate(divide="ignore", invalid="ignore"):
            fit = np.where(m > 0, m * np.log(m / w), 0.0) - prior + best[:r]
        last[r] = int(fit.argmax())
        best[r] = fit.max()
    cuts, at = [len(counts)], len(counts)
    while at:
        at = int(last[at])
        cuts.append(at)
    return edges[cuts[::-1]]


def unimodal(y: Sequence[float]) -> np.ndarray:
    """Least-squares fit that rises to one mode and falls after it: the best over all modes of two monotone fits."""

    def rising(v: np.ndarray) -> np.ndarray:
        level: list[list[float]] = []
        for x in v:
            level.append([float(x), 1.0])
            while len(level) > 1 and level[-2][0] > level[-1][0]:
                m, k = level.pop()
                level[-1] = [(level[-1][0] * level[-1][1] + m * k) / (level[-1][1] + k), level[-1][1] + k]
        return np.concatenate([np.full(int(k), m) for m, k in level]) if level else np.zeros(0)

    y = np.asarray(y, float)
    fits = [np.concatenate([rising(y[:m]), rising(y[m:][::-1])[::-1]]) for m in range(len(y) + 1)]
    return min(fits, key=lambda f: float(((f - y) ** 2).sum()))


def leaf_of(feature: int, family: str, kind: str, counts: Sequence[float], edges: Sequence[float], lo: float, hi: float, alpha: float = 1.0, weight: float = 0.01, variance: float = 1.0) -> Leaf:
    """A histogram, piecewise or isotonic leaf from counts.

    Continuous: ``counts`` lie on a fine grid and are merged to an irregular
    histogram, or to one bin where the variance is nil. Otherwise the bins are
    domain values, smoothed by ``alpha``.
    """
    c, e = np.asarray(counts, float), np.asarray(edges, float)
    if kind == "continuous":
        e, density = (np.array([lo, max(hi, lo + 1e-9)]), None) if variance <= NO_VARIANCE else irregular(c, e)
        density = np.array([1 / (e[-1] - e[0])]) if density is None else density
        prior, points = 1 / max(hi - lo, 1e-9), (e[:-1] + e[1:]) / 2
    else:
        density = (c + alpha) / (c.sum() + alpha * len(c)) / np.diff(e)
        prior, points = 1 / len(c), (e[:-1] + e[1:]) / 2 if family == "histogram" else e[:-1]
    if family == "histogram":
        return Histogram(feature, tuple(map(float, e)), tuple(map(float, density)), tuple(map(float, points)), prior, weight)
    xs, ys = to_piecewise(e, density, kind)
    if family == "isotonic":
        fit = unimodal(ys)
        area = float(np.trapezoid(fit, xs))
        return Isotonic(feature, tuple(xs), tuple(float(v) for v in fit / area), prior, weight)
    return Piecewise(feature, tuple(xs), tuple(ys), prior, weight)

