"""Projections and filters: encodings, outliers, normalisation, discretisation, masks, label rules."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probloom.functions import scalar as S
from probloom.operators.ordered import running_sums


def one_hot(column: str, domain: Sequence[object], strict: bool = True) -> Column:
    """Array of 0/1 by domain value; strict: another value fails the query. NULL stays NULL."""
    hits = F.array(*[(F.col(column) == F.lit(v)).cast("double") for v in domain])
    if not strict:
        return F.when(F.col(column).isNotNull(), hits)
    known = F.col(column).isin(*domain)
    return F.when(known, hits).when(F.col(column).isNotNull(), F.raise_error(F.concat(F.lit(f"one_hot: {column} has a value outside its domain: "), F.col(column).cast("string"))).cast("array<double>"))


def domain_of(df: DataFrame, column: str, most: int = 10_000) -> list:
    """Sorted distinct values of a categorical or discrete column; more than ``most`` is an error."""
    got = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(got)


#: Accuracy of the first, approximate pass of exact quantiles.
NARROW = 2000


def exact_quantiles(df: DataFrame, column: str, at: Sequence[float]) -> list[float]:
    """Exact quantiles with linear interpolation (NULLs don't count), in two passes of bounded memory.

    Approximate quantiles bracket the ranks wanted; the values within the
    brackets, a small share of all, are counted and give the exact ranks.
    """
    x = F.col(column).cast("double")
    rows = df.select(x.alias("v")).where("v IS NOT NULL")
    pad = 2.0 / NARROW
    lo_hi = [min(max(p + e, 0.0), 1.0) for p in at for e in (-pad, pad)]
    n, least, greatest, near = rows.agg(F.count("v"), F.min("v"), F.max("v"), F.percentile_approx("v", lo_hi, NARROW)).first()
    bounds = [(least if p - pad <= 0 else near[2 * i], greatest if p + pad >= 1 else near[2 * i + 1]) for i, p in enumerate(at)]
    below = rows.agg(*[F.count_if(F.col("v") < lo).alias(f"b{i}") for i, (lo, _) in enumerate(bounds)]).first()
    out = []
    for i, (p, (lo, hi)) in enumerate(zip(at, bounds)):
        rank = p * (n - 1)
        some = running_sums(rows.where((F.col("v") >= lo) & (F.col("v") <= hi)).groupBy("v").agg(F.count(F.lit(1)).alias("n")), ["v"], {"to": "n"})
        a, b = (some.where(F.col("to") + below[i] > r).agg(F.min("v")).first()[0] for r in (math.floor(rank), math.ceil(rank)))
        out.append(a + (b - a) * (rank - math.floor(rank)))
    return out


def without_outliers(df: DataFrame, columns: Sequence[str], k: float = 5.0) -> DataFrame:
    """Column by column keep |x - median| < k * population deviation, each on what the one before left.

    NULLs are dropped; a column without spread keeps nothing, as the bound is strict.
    """
    for c in columns:
        x = F.col(c).cast("double")
        s = df.agg(F.stddev_pop(x)).first()[0]
        if s is None:
            return df.where(F.lit(False))
        m = exact_quantiles(df, c, [0.5])[0]
        df = df.where(F.abs(x - S.lit(m)) < S.lit(k * s))
    return df


def complete_cases(df: DataFrame, columns: Sequence[str], sentinel: float, most: int) -> DataFrame:
    """Drop columns with at least ``most`` sentinels, then rows that hold one."""
    n = df.agg(*[F.count_if(F.col(c) == sentinel).alias(c) for c in columns]).first()
    gone = [c for c in columns if n[c] >= most]
    kept = [c for c in columns if c not in gone]
    out = df.drop(*gone)
    for c in kept:
        out = out.where(F.col(c) != sentinel)
    return out


def simplex(columns: Sequence[str], eps: float = 1e-7) -> list[Column]:
    """Shares that add up to 1, away from 0 and 1."""
    soft = [F.when(F.col(c) == 1, S.lit(1 - eps)).when(F.col(c) == 0, S.lit(eps)).otherwise(F.col(c)) for c in columns]
    total = S.add(soft)
    return [(s / total).alias(c) for s, c in zip(soft, columns)]


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace columns by z-scores (population deviation; no spread gives 0)."""
    m = df.agg(*[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"{c}_s") for c in columns]).first()
    return df.withColumns({c: (F.col(c) - S.lit(m[f"{c}_m"] or 0)) / S.lit(m[f"{c}_s"] or 1) for c in columns})


def discretised(df: DataFrame, column: str, out: str) -> DataFrame:
    """z-score, then the number of Freedman-Diaconis edges not above it (0 below the first edge)."""
    x = F.col(column).cast("double")
    m, s, lo, hi, n = df.agg(F.avg(x), F.stddev_pop(x), F.min(x), F.max(x), F.count(x)).first()
    if not n:
        return df.withColumn(out, F.lit(None).cast("int"))
    q = exact_quantiles(df, column, [0.25, 0.75])
    s = s or 1.0
    lo, hi, iqr = (lo - m) / s, (hi - m) / s, (q[1] - q[0]) / s
    width = 2 * iqr / n ** (1 / 3)
    bins = max(1, math.ceil((hi - lo) / width)) if width > 0 else 1
    z = (x - S.lit(m)) / S.lit(s)
    w = (hi - lo) / bins
    return df.withColumn(out, F.when(z >= hi, F.lit(bins + 1)).otherwise(F.least(F.floor((z - S.lit(lo)) / S.lit(w or 1)).cast("int") + 1, F.lit(bins))))


def tf_idf(df: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Smoothed tf-idf of count columns: tf * (ln((1+n)/(1+df)) + 1), rows of unit length."""
    n = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c) > 0).alias(c) for c in counts]).first()
    raw = [F.col(c) * S.lit(math.log((1 + n["n"]) / (1 + n[c])) + 1) for c in counts]
    norm = F.sqrt(S.add([r * r for r in raw]))
    return df.withColumns({c: F.when(norm > 0, r / norm).otherwise(S.lit(0)) for c, r in zip(counts, raw)})


def half_mask(pixels: Column, width: int, half: str) -> Column:
    """The values of the left, right, upper or lower half of a flattened image."""
    keep = {
        "left": lambda x, i: i % width < width // 2, "right": lambda x, i: i % width >= width // 2,
        "up": lambda x, i: i < F.size(pixels) / 2, "down": lambda x, i: i >= F.size(pixels) / 2,
    }[half]
    return F.filter(pixels, keep)


def gray(pixels: Column) -> Column:
    """Gray values of an image stored as all red, all green, all blue values."""
    n = (F.size(pixels) / 3).cast("int")
    r, g, b = F.slice(pixels, F.lit(1), n), F.slice(pixels, n + 1, n), F.slice(pixels, n * 2 + 1, n)
    return F.zip_with(F.zip_with(r, g, lambda x, y: x * 0.2989 + y * 0.5870), b, lambda s, z: s + z * 0.1140)


#: Digits with a stroke of each shape (fixed values).
DIGIT_RULES = {
    "vertical_stroke": (1, 4, 7),
    "circle_stroke": (0, 6, 8, 9),
    "curve_left": (2, 3, 5, 8, 9),
    "curve_right": (5, 6),
    "horizontal_stroke": (2, 3, 4, 5, 7),
    "double_curve": (3, 8),
    "four_or_nine": (4, 9),
}


def label_rules(column: str, rules: dict[str, Sequence[int]] | None = None) -> list[Column]:
    """A 0/1 label per rule."""
    return [F.col(column).isin(*v).cast("int").alias(k) for k, v in (rules or DIGIT_RULES).items()]


def random_rules(rules: int, codes: Sequence[int], seed: int = 1337) -> dict[str, list[int]]:
    """Random patterns: for every rule a random half of the codes."""
    rng = np.random.default_rng(seed)
    return {f"rule_{i}": sorted(int(c) for c, on in zip(codes, rng.random(len(codes)) < 0.5) if on) for i in range(rules)}


def without_classes(df: DataFrame, label: str, classes: Sequence[object]) -> DataFrame:
    """Rows of other classes; rows without a class stay."""
    return df.where(F.col(label).isNull() | ~F.col(label).isin(*classes)) if classes else df


def log_counts(columns: Sequence[str], root: bool = False) -> list[Column]:
    """Counts on a scale for clustering: log(1 + x), or the square root."""
    return [(F.sqrt(c) if root else F.log1p(c)).alias(c) for c in columns]


def informative(tokens: DataFrame, token: str, count: str, least: float, last: Sequence[str] = ()) -> DataFrame:
    """Tokens whose total count is above ``least``; those of ``last`` come last in ``place`` whatever their count."""
    total = tokens.groupBy(token).agg(F.sum(count).alias("total")).where((F.col("total") > least) | F.col(token).isin(*last) if last else F.col("total") > least)
    return total.withColumn("is_last", F.col(token).isin(*last) if last else F.lit(False))
