"""Dependence between columns: randomised dependence coefficient, distance correlation, adjusted mutual information, parameter stability.

Functions on arrays work on small matrices; the randomised dependence
coefficient and the stability test have distributed forms over all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probloom.operators.metrics import adjusted_mutual_information
from probloom.operators.ordered import ecdf, running_sums

#: Scale of the random weights, quantiles that stand for a column's distribution.
SCALE, QUANTILES = 1 / 6, 256


def ranks(x: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Share of the grid not above each value: the empirical distribution function, ties at their greatest rank."""
    return np.searchsorted(grid, x, side="right") / max(len(grid), 1)


def weights_of(width: int, seed: int, k: int) -> np.ndarray:
    """Random weights of a feature of ``width`` columns and the column of ones, scaled by SCALE over the number of columns."""
    return np.random.default_rng(seed).normal(0, 1, (width + 1, k)) * SCALE / (width + 1)


def feature_count(widths: Sequence[int]) -> int:
    """Random features of each column: one more than the widest has columns."""
    return max(widths) + 1


def nonlinear(x: np.ndarray, grid: np.ndarray, seed: int, k: int = 2, codes: Sequence[float] | None = None, shape: Callable[[np.ndarray], np.ndarray] = np.sin) -> np.ndarray:
    """``shape`` of random projections of the rank-transformed column and a constant, less their value at the middle rank.

    ``codes``: the values of a categorical column, which counts as an indicator
    column for each. Taking a constant off changes no correlation.
    """
    if codes is None:
        w = weights_of(1, seed, k)
        return shape(ranks(x, grid)[:, None] * w[0] + w[1]) - shape(0.5 * w[0] + w[1])
    codes = np.asarray(codes, float)
    w = weights_of(len(codes), seed, k)
    share = np.array([np.mean(grid == v) if len(grid) else 0.0 for v in codes])
    plain = shape((1 - share) @ w[:-1] + w[-1])  # no indicator set
    table = np.vstack([shape((1 - share) @ w[:-1] + share[:, None] * w[:-1] + w[-1]), plain]) - plain
    at = np.searchsorted(codes, x)
    return table[np.where(codes[np.minimum(at, len(codes) - 1)] == x, np.minimum(at, len(codes) - 1), len(codes))]


def canonical(cxx: np.ndarray, cyy: np.ndarray, cxy: np.ndarray, ridge: float = 1e-11) -> float:
    """Greatest canonical correlation from covariances."""

    def root(c: np.ndarray) -> np.ndarray:
        w, v = np.linalg.eigh(c + ridge * np.eye(len(c)) * np.trace(c) / len(c))
        keep = w > 1e-10 * max(w.max(), 1e-300)
        return (v[:, keep] / np.sqrt(w[keep])) @ v[:, keep].T

    if np.trace(cxx) < 1e-15 or np.trace(cyy) < 1e-15:
        return 0.0
    return float(min(1.0, np.linalg.svd(root(cxx) @ cxy @ root(cyy), compute_uv=False)[0]))


def rdc_from_moments(n: float, total: np.ndarray, cross: np.ndarray, columns: int, k: int = 2) -> np.ndarray:
    """Coefficients of all pairs from the sums and cross-products of their features."""
    mean = total / n
    cov = cross / n - np.outer(mean, mean)
    out = np.eye(columns)
    for i in range(columns):
        a = slice(i * k, (i + 1) * k)
        for j in range(i + 1, columns):
            b = slice(j * k, (j + 1) * k)
            out[i, j] = out[j, i] = canonical(cov[a, a], cov[b, b], cov[a, b])
    return out


def rdc_matrix(x: np.ndarray, codes: dict[int, Sequence[float]] | None = None) -> np.ndarray:
    """Randomised dependence coefficients of the columns of a small matrix; ``codes`` of the categorical ones."""
    codes = codes or {}
    k = feature_count([len(codes.get(i, ())) or 1 for i in range(x.shape[1])])
    f = np.hstack([nonlinear(c, np.sort(c), 42 + i, k, codes.get(i)) for i, c in enumerate(x.T)])
    return rdc_from_moments(len(x), f.sum(0), f.T @ f, x.shape[1], k)


def rdc_exact(df: DataFrame, columns: Sequence[str], weights: Sequence[np.ndarray] | None = None) -> np.ndarray:
    """Coefficients of continuous columns from exact ranks of all rows, in plain expressions; ``weights``: (2, k) of each column.

    Rows with a NULL in any column are left out. Fewer than two rows give no dependence.
    """
    weights = weights or [weights_of(1, 42 + i, 2) for i in range(len(columns))]
    k = weights[0].shape[1]
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    for i in range(len(columns)):
        rows = ecdf(rows, f"c{i}", f"u{i}")
    f = [F.sin(F.col(f"u{i}") * float(w[0, j]) + float(w[1, j])) - float(math.sin(0.5 * w[0, j] + w[1, j])) for i, w in enumerate(weights) for j in range(k)]
    m = len(f)
    got = rows.select(*[x.alias(f"f{i}") for i, x in enumerate(f)]).agg(F.count(F.lit(1)), *[F.sum(f"f{i}") for i in range(m)], *[F.sum(F.col(f"f{i}") * F.col(f"f{j}")) for i in range(m) for j in range(m)]).first()
    if got[0] < 2:
        return np.eye(len(columns))
    return rdc_from_moments(got[0], np.array(got[1 : m + 1]), np.array(got[m + 1 :]).reshape(m, m), len(columns), k)


def rdc(df: DataFrame, columns: Sequence[str], codes: dict[int, Sequence[float]] | None = None) -> np.ndarray:
    """Randomised dependence coefficients of columns over all rows: one pass for quantiles, one for moments.

    Rows with a NULL in any column are left out. ``codes``: the values of categorical columns, by place.
    """
    codes = codes or {}
    k = feature_count([len(codes.get(i, ())) or 1 for i in range(len(columns))])
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    at = [(i + 1) / QUANTILES for i in range(QUANTILES)]
    got = rows.agg(*[F.percentile_approx(f"c{i}", at, 10_000).alias(f"q{i}") for i in range(len(columns))]).first()
    if got is None or got[0] is None:
        return np.eye(len(columns))
    grids = [np.array(q) for q in got]

    def reduce_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            f = np.hstack([nonlinear(np.asarray(b.column(i)), grids[i], 42 + i, k, codes.get(i)) for i in range(len(grids))])
            s = np.concatenate([[len(f)], f.sum(0), (f.T @ f).ravel()])
            total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    s = rows.mapInArrow(reduce_, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
    m = len(columns) * k
    return rdc_from_moments(s[0], s[1 : m + 1], s[m + 1 :].reshape(m, m), len(columns), k)


def _row_sums(v: np.ndarray) -> np.ndarray:
    """Sum of the distances of each value to all."""
    order = np.argsort(v, kind="stable")
    w, n = v[order], len(v)
    below = np.concatenate([[0.0], np.cumsum(w)[:-1]])
    out = np.empty(n)
    out[order] = w * np.arange(n) - below + (w.sum() - below - w) - w * (n - 1 - np.arange(n))
    return out


def _cross(x: np.ndarray, y: np.ndarray) -> float:
    """Sum over all pairs of |x_i - x_j| |y_i - y_j|, by merging blocks in the order of x: n log n steps a level."""
    order = np.lexsort((y, x))
    x, y, n = x[order], y[order], len(x)
    rank = np.empty(n, np.int64)
    rank[np.argsort(y, kind="stable")] = np.arange(n)
    parts = np.stack([np.ones(n), x, y, x * y])
    total, width, at = 0.0, 1, np.arange(n)
    while width < n:
        pair = at // (2 * width)
        left = (at // width) % 2 == 0
        first, later = np.nonzero(left)[0], np.nonzero(~left)[0]
        key = pair[first] * n + rank[first]
        by = np.argsort(key)
        first, key = first[by], key[by]
        run = np.concatenate([np.zeros((4, 1)), np.cumsum(parts[:, first], 1)], 1)
        lo = np.searchsorted(key, pair[later] * n)
        mid = np.searchsorted(key, pair[later] * n + rank[later])
        hi = np.searchsorted(key, (pair[later] + 1) * n)
        signed = 2 * run[:, mid] - run[:, lo] - run[:, hi]  # lower ranks less higher ones
        total += float((x[later] * y[later] * signed[0] - y[later] * signed[1] - x[later] * signed[2] + signed[3]).sum())
        width *= 2
    return 2 * total


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Distance correlation of two columns, exactly, in n log^2 n steps."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = float(len(x))
    x, y = x - x.mean(), y - y.mean()
    a, b = _row_sums(x), _row_sums(y)
    covariance = lambda cross, p, q: cross / n**2 - 2 * (p @ q) / n**3 + p.sum() * q.sum() / n**4
    va, vb = (covariance(2 * n * (v @ v) - 2 * v.sum() ** 2, s, s) for v, s in ((x, a), (y, b)))
    return float(math.sqrt(max(covariance(_cross(x, y), a, b), 0) / math.sqrt(va * vb))) if va > 1e-12 and vb > 1e-12 else 0.0


def distance_matrix(x: np.ndarray) -> np.ndarray:
    d = x.shape[1]
    out = np.eye(d)
    for i in range(d):
        for j in range(i + 1, d):
            out[i, j] = out[j, i] = distance_correlation(x[:, i], x[:, j])
    return out


def binned(x: np.ndarray, kind: str) -> np.ndarray:
    """Codes of a column: values for discrete and categorical ones, Freedman-Diaconis bins of z-scores for continuous ones."""
    if kind != "continuous":
        return np.unique(x, return_inverse=True)[1]
    z = (x - x.mean()) / (x.std() or 1)
    iqr = np.subtract(*np.percentile(z, [75, 25]))
    bins = max(1, math.ceil((z.max() - z.min()) / (2 * iqr / len(z) ** (1 / 3)))) if iqr > 0 else 1
    return np.digitize(z, np.linspace(z.min(), z.max(), bins + 1)[1:-1])


def ami_matrix(x: np.ndarray, kinds: Sequence[str]) -> np.ndarray:
    """Adjusted mutual information of all pairs of columns of a small matrix."""
    codes = [binned(c, k) for c, k in zip(x.T, kinds)]
    out = np.eye(len(codes))
    for i in range(len(codes)):
        for j in range(i + 1, len(codes)):
            t = np.zeros((codes[i].max() + 1, codes[j].max() + 1))
            np.add.at(t, (codes[i], codes[j]), 1)
            out[i, j] = out[j, i] = adjusted_mutual_information(t)
    return out


def bonferroni(p: float, tests: int) -> float:
    """p-value corrected for a number of tests: their sum where small, else the chance of the least of them."""
    return min(1.0, tests * p if p <= 0.001 else 1 - (1 - p) ** tests)


def sup_lm_pvalue(stat: float, trim: float = 0.1) -> float:
    """Tail of the supremum of the squared standardised Brownian bridge over the trimmed range (one parameter).

    Asymptotic expansion: sqrt(c/2) e^(-c/2) / Gamma(1/2) * ((1 - 1/c) ln l + 2/c), l = ((1 - trim) / trim)^2.
    """
    if stat <= 1:
        return 1.0
    lam = ((1 - trim) / trim) ** 2
    return float(min(1.0, math.sqrt(stat / 2) * math.exp(-stat / 2) / math.gamma(0.5) * ((1 - 1 / stat) * math.log(lam) + 2 / stat)))


def stability_pvalues(x: np.ndarray) -> np.ndarray:
    """p-values that the mean of column i (intercept-only Poisson model) is stable along column j, Bonferroni-corrected."""
    n, d = x.shape
    out = np.ones((d, d))
    first = int(max(math.ceil(0.1 * n), 10))
    if first >= n - first:
        return np.zeros((d, d))
    t = np.arange(first, n - first + 1) / n
    for i in range(d):
        r = x[:, i] - x[:, i].mean()
        scale = math.sqrt((r * r).sum())
        if scale == 0:
            continue
        for j in range(d):
            if i != j:
                path = np.cumsum((r / scale)[np.argsort(x[:, j], kind="stable")])
                out[i, j] = bonferroni(sup_lm_pvalue(float((path[first - 1 : n - first] ** 2 / (t * (1 - t))).max())), d - 1)
    return out


def stability_over_rows(df: DataFrame, groups: dict[int, Sequence[str]], key: Sequence[str], group: dict[str, str] | None = None) -> dict[int, np.ndarray]:
    """``stability_pvalues`` over all rows of several groups: their columns by number; ties are in the order of ``key``, which is total.

    ``group``: per column the name of the column that holds the number of the
    row's group; without it all rows are one group. Needs no NULLs.
    """
    columns = sorted({c for cs in groups.values() for c in cs})
    owner = {c: F.col(group[c]).cast("long") if group else F.lit(next(iter(groups))).cast("long") for c in columns}
    first = {no: cs[0] for no, cs in groups.items()}
    mine = {no: owner[c] == no for no, c in first.items()}
    sums = df.agg(*[x for no, cs in groups.items() for x in (F.count_if(mine[no]).alias(f"n{no}"), *[F.avg(F.when(mine[no], F.col(c))).alias(f"m{no}_{c}") for c in cs])]).first()
    squares = df.agg(*[F.sum(F.when(mine[no], (F.col(c) - (sums[f"m{no}_{c}"] or 0.0)) ** 2)).alias(f"q{no}_{c}") for no, cs in groups.items() for c in cs]).first()
    out, open_ = {}, {}
    for no, cs in groups.items():
        n = sums[f"n{no}"]
        low = int(max(math.ceil(0.1 * n), 10))
        out[no] = np.ones((len(cs), len(cs))) if low < n - low or not n else np.zeros((len(cs), len(cs)))
        if low < n - low:
            open_[no] = (n, low)
    if not open_:
        return out
    most = max(len(groups[no]) for no in open_)
    scaled = lambda no, c: (F.col(c) - sums[f"m{no}_{c}"]) / math.sqrt(squares[f"q{no}_{c}"]) if squares[f"q{no}_{c}"] > 0 else F.lit(0.0)
    # A row for each open group and each column that orders it: the residuals of all columns of the group.
    lines = [
        F.when(mine[no], F.struct(F.lit(no).cast("long").alias("__no"), F.lit(j).alias("__j"), F.col(c).cast("double").alias("__z"), *[(scaled(no, groups[no][i]) if i < len(groups[no]) else F.lit(0.0)).alias(f"__r{i}") for i in range(most)]))
        for no in open_ for j, c in enumerate(groups[no])
    ]
    rows = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.explode(F.array(*lines)).alias("__l")).where("__l IS NOT NULL").select("__l.*", *[f"__k{i}" for i in range(len(key))])
    rows = rows.withColumn("__one", F.lit(1).cast("long"))
    path = running_sums(rows, ["__z", *[f"__k{i}" for i in range(len(key))]], {"__at": "__one"} | {f"__p{i}": f"__r{i}" for i in range(most)}, ["__no", "__j"])
    bounds = F.broadcast(df.sparkSession.createDataFrame([(no, *v) for no, v in open_.items()], "__no long, __n long, __low long"))  # a row per group
    t = F.col("__at") / F.col("__n")
    path = path.join(bounds, "__no").where("__at >= __low AND __at <= __n - __low")
    for r in path.groupBy("__no", "__j").agg(*[F.max(F.col(f"__p{i}") ** 2 / (t * (1 - t))).alias(f"__s{i}") for i in range(most)]).collect():
        no, j, d = r["__no"], r["__j"], len(groups[r["__no"]])
        for i, c in enumerate(groups[no]):
            if i != j and squares[f"q{no}_{c}"] > 0:
                out[no][i, j] = bonferroni(sup_lm_pvalue(float(r[f"__s{i}"])), d - 1)
    return out


def overlapping_blocks(d: int, block: int = 50) -> list[list[int]]:
    return [list(range(a, min(a + block, d))) for a in range(0, d, max(block // 2, 1))]


def blockwise_pvalues(x: np.ndarray, block: int = 50) -> np.ndarray:
    """Median p-value over overlapping blocks of columns, for wide tables."""
    blocks = overlapping_blocks(x.shape[1], block)
    return blockwise_median(x.shape[1], blocks, [stability_pvalues(x[:, cols]) for cols in blocks])


def blockwise_median(d: int, blocks: Sequence[Sequence[int]], values: Sequence[np.ndarray]) -> np.ndarray:
    found: dict[tuple[int, int], list[float]] = {}
    for cols, p in zip(blocks, values):
        for u, i in enumerate(cols):
            for v, j in enumerate(cols):
                if i != j:
                    found.setdefault((i, j), []).append(float(p[u, v]))
    out = np.ones((d, d))
    for (i, j), v in found.items():
        out[i, j] = float(np.median(v))
    return out
