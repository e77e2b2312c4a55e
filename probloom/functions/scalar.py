"""Scalar functions as Column expressions: densities, log-gamma, folds over arrays, interpolation.

Everything here stays in the JVM except the incomplete gamma function, which is
an Arrow-batched UDF. Missing values are NULL throughout, never NaN.
"""

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Log of a zero probability, and the least density that a leaf reports.
LOG_ZERO, LEAST = -1e3, 1e-15


def lit(x: float) -> Column:
    return F.lit(float(x))


def add(xs: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def safe_log(p: Column) -> Column:
    """ln p, or the log-zero constant where p isn't positive (Spark's ln(0) is NULL)."""
    return F.when(p > 0, F.ln(p)).when(p.isNotNull(), lit(LOG_ZERO))


def is_log_zero(x: Column) -> Column:
    return x <= LOG_ZERO


def lgamma(z: Column) -> Column:
    """Log-gamma of positive z: Stirling's series eight steps up."""
    w = z + 8.0
    r = 1.0 / (w * w)
    series = (1.0 / w) * (lit(1 / 12) - r * (lit(1 / 360) - r * (lit(1 / 1260) - r * (lit(1 / 1680) - r * lit(1 / 1188)))))
    rising = reduce(lambda a, b: a * b, [z + float(i) for i in range(8)])
    return (w - 0.5) * F.ln(w) - w + lit(0.5 * math.log(2 * math.pi)) + series - F.ln(rising)


def log_factorial(x: Column) -> Column:
    """ln x!, for real x >= 0; NULL below."""
    return F.when(x >= 0, lgamma(x.cast("double") + 1.0))


def log_poisson(x: Column, mean: Column | float) -> Column:
    """Log-probability of a count; NULL for negative counts, the log-zero constant for a mean that isn't positive."""
    m = mean if isinstance(mean, Column) else lit(mean)
    return F.when(m > 0, x * F.ln(m) - m - log_factorial(x)).when(x.isNotNull(), lit(LOG_ZERO))


def poisson(x: Column, mean: Column | float) -> Column:
    return F.exp(log_poisson(x, mean))


def gaussian(x: Column, mean: Column | float, variance: Column | float) -> Column:
    """Normal density by mean and variance; an exact 0 becomes 1e-15."""
    m, v = (c if isinstance(c, Column) else lit(c) for c in (mean, variance))
    p = F.exp(-(x - m) * (x - m) / (2.0 * v)) / F.sqrt(lit(2 * math.pi) * v)
    return F.when(p == 0, lit(LEAST)).otherwise(p)


def log_gaussian(x: Column, mean: Column | float, variance: Column | float) -> Column:
    """Log of the normal density, in closed form so that far tails stay finite."""
    m, v = (c if isinstance(c, Column) else lit(c) for c in (mean, variance))
    return -(x - m) * (x - m) / (2.0 * v) - 0.5 * F.ln(lit(2 * math.pi) * v)


def bernoulli(x: Column, p: Column | float) -> Column:
    """p where x is 1, 1-p for anything else."""
    q = p if isinstance(p, Column) else lit(p)
    return F.when(x == 1, q).when(x.isNotNull(), 1.0 - q)


def bernoulli_strict(x: Column, p: Column | float) -> Column:
    """As :func:`bernoulli`, but other values than 0 and 1 fail the query."""
    q = p if isinstance(p, Column) else lit(p)
    return F.when(x == 1, q).when(x == 0, 1.0 - q).when(x.isNotNull(), F.raise_error(F.lit("bernoulli: value is neither 0 nor 1")).cast("double"))


def log_bernoulli(x: Column, p: Column | float) -> Column:
    return safe_log(bernoulli(x, p))


def log_gamma_pdf(x: Column, concentration: float, rate: float) -> Column:
    return F.when(x > 0, lit(concentration * math.log(rate) - math.lgamma(concentration)) + lit(concentration - 1) * F.ln(x) - lit(rate) * x).when(x.isNotNull(), lit(LOG_ZERO))


def gamma_pdf(x: Column, concentration: float, rate: float) -> Column:
    return F.when(x > 0, F.exp(log_gamma_pdf(x, concentration, rate))).when(x.isNotNull(), lit(0))


def log_beta_pdf(x: Column, alpha: float, beta: float) -> Column:
    c = math.lgamma(alpha + beta) - math.lgamma(alpha) - math.lgamma(beta)
    return F.when((x > 0) & (x < 1), lit(c) + lit(alpha - 1) * F.ln(x) + lit(beta - 1) * F.ln(1.0 - x)).when(x.isNotNull(), lit(LOG_ZERO))


def beta_pdf(x: Column, alpha: float, beta: float) -> Column:
    return F.when((x > 0) & (x < 1), F.exp(log_beta_pdf(x, alpha, beta))).when(x.isNotNull(), lit(0))


def log_dirichlet(xs: Sequence[Column], alphas: Sequence[float]) -> Column:
    """Log-density of a point of the simplex."""
    c = math.lgamma(sum(alphas)) - sum(math.lgamma(a) for a in alphas)
    return lit(c) + add([lit(a - 1) * safe_log(x) for x, a in zip(xs, alphas)])


def _upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function, by series below a+1 and continued fraction above."""
    out = np.ones_like(x)
    lead = np.exp(-x + a * np.log(np.maximum(x, 1e-300)) - np.array([math.lgamma(v) for v in a]))
    low = (x > 0) & (x < a + 1)
    term = np.where(low, 1 / a, 0.0)
    total, k = term.copy(), a.copy()
    for _ in range(500):
        k = k + 1
        term = term * np.where(low, x, 0) / k
        total += term
        if np.abs(term).max(initial=0) < 1e-16:
            break
    out = np.where(low, 1 - lead * total, out)
    high = x >= a + 1
    b = x + 1 - a
    c, d = np.full_like(x, 1e300), 1 / np.where(high, b, 1.0)
    h = d.copy()
    for i in range(1, 500):
        an = -i * (i - a)
        b = b + 2
        d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
        c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
        h = h * np.where(high, d * c, 1.0)
        if np.abs(d * c - 1)[high].max(initial=0) < 1e-15:
            break
    return np.where(high, lead * h, out)


def _chi2_tail(x: pd.Series, k: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=x.index)
    ok = x.notna() & k.notna() & (k > 0)
    out[ok] = _upper_gamma(k[ok].to_numpy(float) / 2, np.maximum(x[ok].to_numpy(float), 0) / 2)
    return out


def chi2_sf(x: Column, k: Column) -> Column:
    """Upper tail of the chi-square distribution with k degrees of freedom; NULL where x or k is."""
    tail = F.pandas_udf(_chi2_tail, "double")
    return F.nanvl(tail(x.cast("double"), k.cast("double")), F.lit(None).cast("double"))


def chi2_cdf(x: Column, k: Column) -> Column:
    return 1.0 - chi2_sf(x, k)


def log_chi2_sf(x: Column, k: Column) -> Column:
    return safe_log(chi2_sf(x, k))


def log_sum_exp(values: Column) -> Column:
    """ln of the sum of exponentials of an array, in one pass with a running maximum; NULL elements count as absent."""
    start = F.struct(lit(-1.7e308).alias("m"), lit(0).alias("s"))

    def step(a: Column, x: Column) -> Column:
        grown = F.struct(x.alias("m"), (a["s"] * F.exp(a["m"] - x) + 1.0).alias("s"))
        same = F.struct(a["m"].alias("m"), (a["s"] + F.exp(x - a["m"])).alias("s"))
        return F.when(x.isNull(), a).when(x > a["m"], grown).otherwise(same)

    return F.aggregate(values, start, step, lambda a: F.when(a["s"] > 0, a["m"] + F.ln(a["s"])))


def log_add_exp(a: Column, b: Column) -> Column:
    """ln(e^a + e^b) of two columns."""
    top = F.greatest(a, b)
    return top + F.log1p(F.exp(F.least(a, b) - top))


def interpolate(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise-linear interpolation, constant beyond the ends."""
    if len(xs) == 1:
        return F.when(x.isNotNull(), lit(ys[0]))

    def line(i: int) -> Column:
        slope = (ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i])
        return lit(ys[i]) + lit(slope) * (x - lit(xs[i]))

    def between(lo: int, hi: int) -> Column:
        """The line of the piece among lo..hi-1 that holds x, by halving."""
        if hi - lo == 1:
            return line(lo)
        mid = (lo + hi) // 2
        return F.when(x < lit(xs[mid]), between(lo, mid)).otherwise(between(mid, hi))

    return F.when(x <= xs[0], lit(ys[0])).when(x >= xs[-1], lit(ys[-1])).when(x.isNotNull(), between(0, len(xs) - 1))


def bin_index(x: Column, edges: Sequence[float]) -> Column:
    """Bin from 0 of right-open bins, the last one closed; NULL outside.

    Edges of equal distance give the bin by division, put right by one look at
    its own edges; others by halving.
    """
    e, n = [float(v) for v in edges], len(edges) - 1
    width = (e[-1] - e[0]) / n if n else 0.0
    if n > 2 and width > 0 and all(abs(v - (e[0] + i * width)) < 1e-3 * width for i, v in enumerate(e)):
        at = F.expr("array(" + ",".join(f"{v!r}D" for v in e) + ")")
        i = F.least(F.greatest(F.floor((x - lit(e[0])) / lit(width)).cast("int"), F.lit(0)), F.lit(n - 1))
        inner = i + F.when(F.get(at, i) > x, F.lit(-1)).when((F.get(at, i + 1) <= x) & (i < n - 1), F.lit(1)).otherwise(F.lit(0))
    else:
        inner = _halved(x, e, 0, n)
    return F.when((x >= edges[0]) & (x < edges[-1]), inner).when(x == edges[-1], F.lit(len(edges) - 2))


def _halved(x: Column, edges: Sequence[float], lo: int, hi: int) -> Column:
    """The i of lo..hi-1 with edges[i] <= x < edges[i + 1]."""
    if hi - lo <= 1:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(x < lit(edges[mid]), _halved(x, edges, lo, mid)).otherwise(_halved(x, edges, mid, hi))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def dot(cols: Sequence[Column], weights: Sequence[float]) -> Column:
    return add([c * lit(w) for c, w in zip(cols, weights)])


def sine_features(u: Column, weights: Sequence[float], shifts: Sequence[float]) -> list[Column]:
    """Non-linear random features of a rank-transformed column."""
    return [F.sin(u * lit(w) + lit(b)) for w, b in zip(weights, shifts)]


def hyperplane_side(cols: Sequence[Column], means: Sequence[float], plane: Sequence[float]) -> Column:
    """1 where the centred point lies on the positive side of the plane, else 0."""
    return (dot([c - lit(m) for c, m in zip(cols, means)], plane) > 0).cast("int")


def bit_power_sum(bits: Sequence[Column]) -> Column:
    """Sum of 2^bit over binary labels (not a positional code: two labels set in any place give the same)."""
    return add([F.pow(lit(2), b.cast("double")) for b in bits]).cast("long")


def to_cartesian(bary: Sequence[Column]) -> tuple[Column, Column]:
    """Position of barycentric coordinates in the regular polygon of as many corners."""
    n = len(bary)
    corner = [(math.cos(2 * math.pi * i / n + math.pi / 2), math.sin(2 * math.pi * i / n + math.pi / 2)) for i in range(n)]
    return dot(bary, [c[0] for c in corner]), dot(bary, [c[1] for c in corner])


def to_barycentric(x: Column, y: Column) -> list[Column]:
    """Inverse of :func:`to_cartesian` for three corners."""
    (ax, ay), (bx, by), (cx, cy) = [(math.cos(2 * math.pi * i / 3 + math.pi / 2), math.sin(2 * math.pi * i / 3 + math.pi / 2)) for i in range(3)]
    d = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
    a = (lit(by - cy) * (x - cx) + lit(cx - bx) * (y - cy)) / d
    b = (lit(cy - ay) * (x - cx) + lit(ax - cx) * (y - cy)) / d
    return [a, b, 1.0 - a - b]


def epoch_hour(seconds: Column) -> Column:
    """Hour of day of an epoch, in the session's time zone."""
    return F.hour(F.timestamp_seconds(seconds))


def parse_pairs(text: Column) -> Column:
    """Map of a ``k=v,k=v`` list, brackets and blanks removed."""
    return F.str_to_map(F.translate(F.trim(text), "[]() ", ""), F.lit(","), F.lit("="))


def words(text: Column, stop: Sequence[str] = ()) -> Column:
    """Lower-case words without punctuation and stop words."""
    cleaned = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")), " ")
    kept = F.filter(cleaned, lambda w: w != "")
    return F.filter(kept, lambda w: ~w.isin(*stop)) if stop else kept


def as_json(**fields: object) -> Column:
    """A configuration as JSON text, keys in the given order."""
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


def equation(text: str) -> Column:
    """A formula over column names as an expression that Catalyst compiles."""
    return F.expr(text)
