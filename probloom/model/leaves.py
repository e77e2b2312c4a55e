"""Leaf distributions: log-density as a Column and in numpy, mode, sampler, SQL text.

A leaf is a frozen dataclass over one feature (a column position). A NULL (numpy:
NaN) value is unobserved and contributes log-probability 0, which integrates the
leaf out. The four forms of a density agree; tests hold them together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from probloom.functions import scalar as S
from probloom.functions.scalar import LOG_ZERO


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def _sql(x: float) -> str:
    return f"({float(x)!r}::DOUBLE)"


@dataclass(frozen=True)
class Leaf:
    feature: int

    @property
    def scope(self) -> frozenset[int]:
        return frozenset([self.feature])

    def column(self, x: Column) -> Column:
        """Log-density of a non-null value."""
        raise NotImplementedError

    def numpy(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def sql(self, x: str) -> str:
        """Log-density as ANSI SQL over ``x``."""
        raise NotImplementedError(type(self).__name__)

    def mode(self) -> tuple[float, float]:
        """Most probable value and its score."""
        raise NotImplementedError(type(self).__name__)

    def sample(self, rng: np.random.Generator, n: int) -> np.ndarray:
        raise NotImplementedError(type(self).__name__)

    def mean(self) -> float:
        raise NotImplementedError(type(self).__name__)


@dataclass(frozen=True)
class Bernoulli(Leaf):
    p: float = 0.5

    def column(self, x: Column) -> Column:
        return S.log_bernoulli(x, self.p)

    def numpy(self, x: np.ndarray) -> np.ndarray:
        p = np.where(x == 1, self.p, 1 - self.p)
        return np.where(p > 0, np.log(np.maximum(p, 1e-300)), LOG_ZERO)

    def sql(self, x: str) -> str:
        one, other = (math.log(q) if q > 0 else LOG_ZERO for q in (self.p, 1 - self.p))
        return f"CASE WHEN {x} = 1 THEN {_sql(one)} ELSE {_sql(other)} END"

    def mode(self) -> tuple[float, float]:
        return float(self.p > 0.5), math.log(max(self.p, 1 - self.p))

    def sample(self, rng: np.random.Generator, n: int) -> np.ndarray:
        return (rng.random(n) < self.p).astype(float)

    def mean(self) -> float:
        return self.p


@dataclass(frozen=True)
class Poisson(Leaf):
    rate: float = 1.0

    def column(self, x: Column) -> Column:
        return S.log_poisson(x, self.rate)

    def numpy(self, x: np.ndarray) -> np.ndarray:
        return x * math.log(self.rate) - self.rate - _lgamma(np.maximum(x, 0) + 1)

    def sql(self, x: str) -> str:
        return f"({x} * {_sql(math.log(self.rate))} - {_sql(self.rate)} - lgamma({x} + 1))"

    def mode(self) -> tuple[float, float]:
        m = float(math.floor(self.rate))
        return m, float(self.numpy(np.array([m]))[0])

    def sample(self, rng: np.random.Generator, n: int) -> np.ndarray:
        return rng.poisson(self.rate, n).astype(float)

    def mean(self) -> float:
        return self.rate


#: Least standard deviation of a fitted Gaussian.
LEAST_DEVIATION = 0.4


@dataclass(frozen=True)
class Gaussian(Leaf):
    mu: float = 0.0
    sd: float = 1.0

    def column(self, x: Column) -> Column:
        return S.log_gaussian(x, self.mu, self.sd**2)

    def numpy(self, x: np.ndarray) -> np.ndarray:
        return -((x - self.mu) ** 2) / (2 * self.sd**2) - 0.5 * math.log(2 * math.pi * self.sd**2)

    def sql(self, x: str) -> str:
        return f"(-(({x}) - {_sql(self.mu)}) * (({x}) - {_sql(self.mu)}) / {_sql(2 * self.sd**2)} - {_sql(0.5 * math.log(2 * math.pi * self.sd**2))})"

    def mode(self) -> tuple[float, float]:
        return self.mu, -0.5 * math.log(2 * math.pi * self.sd**2)

    def sample(self, rng: np.random.Generator, n: int) -> np.ndarray:
        return rng.normal(self.mu, self.sd, n)

    def mean(self) -> float:
        return self.mu


def _mix(inside: float, prior: float, weight: float) -> float:
    p = weight * prior + (1 - weight) * inside
    return math.log(p) if p > 0 else LOG_ZERO


@dataclass(frozen=True)
class Histogram(Leaf):
    """Densities of right-open bins (the last closed), mixed with a flat prior; only the prior outside the bins."""

    edges: tuple[float, ...] = (0.0, 1.0)
    density: tuple[float, ...] = (1.0,)
    points: tuple[float, ...] = (0.5,)
    prior: float = 1.0
    weight: float = 0.01

    def _logs(self) -> list[float]:
        return [_mix(d, self.prior, self.weight) for d in self.density]

    def column(self, x: Column) -> Column:
        logs = F.array(*[S.lit(v) for v in self._logs()])
        return F.coalesce(F.element_at(logs, S.bin_index(x, self.edges) + 1), S.lit(_mix(0, self.prior, self.weight)))

    def numpy(self, x: np.ndarray) -> np.ndarray:
        e = np.array(self.edges)
        i = np.clip(np.searchsorted(e, x, side="right") - 1, 0, len(e) - 2)
        return np.where((x >= e[0]) & (x <= e[-1]), np.array(self._logs())[i], _mix(0, self.prior, self.weight))

    def sql(self, x: str) -> str:
        e, logs = self.edges, self._logs()
        arms = " ".join(f"WHEN {x} >= {_sql(e[i])} AND {x} {'<=' if i == len(logs) - 1 else '<'} {_sql(e[i + 1])} THEN {_sql(v)}" for i, v in enumerate(logs))
        return f"CASE {arms} ELSE {_sql(_mix(0, self.prior, self.weight))} END"

    def mode(self) -> tuple[float, float]:
        i = int(np.argmax(self.density))
        return self.points[i], max(math.log(max(self.density[i], 1e-300)), math.log(self.weight * self.prior) if self.weight * self.prior > 0 else LOG_ZERO)

    def sample(self, rng: np.random.Generator, n: int) -> np.ndarray:
        e = np.array(self.edges)
        mass = np.array(self.density) * np.diff(e)
        i = rng.choice(len(mass), n, p=mass / mass.sum())
        return e[i] + rng.random(n) * np.diff(e)[i]

    def mean(self) -> float:
        mass = np.array(self.density) * np.diff(self.edges)
        return float((mass * (np.array(self.edges[:-1]) + np.array(self.edges[1:])) / 2).sum() / mass.sum())


@dataclass(frozen=True)
class Piecewise(Leaf):
    """A piecewise-linear density of area 1, mixed with a flat prior."""

    xs: tuple[float, ...] = (0.0, 1.0)
    ys: tuple[float, ...] = (1.0, 1.0)
    prior: float = 1.0
    weight: float = 0.01

    def column(self, x: Column) -> Column:
        return S.safe_log(S.lit(self.weight * self.prior) + S.lit(1 - self.weight) * S.interpolate(x, self.xs, self.ys))

    def numpy(self, x: np.ndarray) -> np.ndarray:
        p = self.weight * self.prior + (1 - self.weight) * np.interp(x, self.xs, self.ys)
        return np.where(p > 0, np.log(np.maximum(p, 1e-300)), LOG_ZERO)

    def sql(self, x: str) -> str:
        arms = [f"WHEN {x} <= {_sql(self.xs[0])} THEN {_sql(self.ys[0])}"]
        for a, b, u, v in zip(self.xs, self.xs[1:], self.ys, self.ys[1:]):
            arms.append(f"WHEN {x} < {_sql(b)} THEN {_sql(u)} + {_sql(v - u)} * ({x} - {_sql(a)}) / {_sql(b - a)}")
        p = f"({_sql(self.weight * self.prior)} + {_sql(1 - self.weight)} * (CASE {' '.join(arms)} ELSE {_sql(self.ys[-1])} END))"
        return f"CASE WHEN {p} > 0 THEN ln({p}) ELSE {_sql(LOG_ZERO)} END"

    def mode(self) -> tuple[float, float]:
        i = int(np.argmax(self.ys))
        least = self.weight * self.prior
        return self.xs[i], max(math.log(max(self.ys[i], 1e-300)), math.log(least) if least > 0 else LOG_ZERO)

    def masses(self) -> np.ndarray:
        """Normalised mass of every segment."""
        m = np.diff(self.xs) * (np.array(self.ys[:-1]) + np.array(self.ys[1:])) / 2
        return m / m.sum()

    def sample(self, rng: np.random.Generator, n: int) -> np.ndarray:
        """Exact draws: a segment by mass, then the inverse of its quadratic distribution function."""
        i = rng.choice(len(self.xs) - 1, n, p=self.masses())
        a, b, u, v = (np.array(t)[i] for t in (self.xs[:-1], self.xs[1:], self.ys[:-1], self.ys[1:]))
        r = rng.random(n)
        flat = np.abs(v - u) < 1e-12 * (u + v)
        root = np.sqrt(u * u + r * (v * v - u * u))
        t = np.where(flat, r, (root - u) / np.where(flat, 1, v - u))
        return a + t * (b - a)

    def mean(self) -> float:
        a, b, u, v = (np.array(t) for t in (self.xs[:-1], self.xs[1:], self.ys[:-1], self.ys[1:]))
        area = (b - a) * (u + v) / 2
        centre = (b - a) * (a * u + (a + b) * (u + v) + b * v) / 6
        return float(centre.sum() / area.sum())


class Isotonic(Piecewise):
    """A piecewise leaf whose density rises to one mode and falls after it."""


@dataclass(frozen=True)
class KernelDensity(Leaf):
    """Gaussian kernels on the leaf's points, mixed with a flat prior. ``shares``: of the rows at each point; none where all are equal."""

    data: tuple[float, ...] = (0.0,)
    bandwidth: float = 0.2
    prior: float = 0.0
    weight: float = 0.0
    shares: tuple[float, ...] = ()

    def _shares(self) -> tuple[float, ...]:
        return self.shares or (1 / len(self.data),) * len(self.data)

    def column(self, x: Column) -> Column:
        pts = F.array(*[F.struct(S.lit(v).alias("v"), S.lit(w).alias("w")) for v, w in zip(self.data, self._shares())])
        h = self.bandwidth
        total = F.aggregate(pts, S.lit(0), lambda a, p: a + p["w"] * F.exp(-(x - p["v"]) * (x - p["v"]) / (2 * h * h)))
        return S.safe_log(S.lit(self.weight * self.prior) + S.lit((1 - self.weight) / (h * math.sqrt(2 * math.pi))) * total)

    def numpy(self, x: np.ndarray) -> np.ndarray:
        d = np.array(self.data)
        k = np.exp(-((np.asarray(x)[:, None] - d[None]) ** 2) / (2 * self.bandwidth**2)) @ np.array(self._shares()) / (self.bandwidth * math.sqrt(2 * math.pi))
        p = self.weight * self.prior + (1 - self.weight) * k
        return np.where(p > 0, np.log(np.maximum(p, 1e-300)), LOG_ZERO)

    def mode(self) -> tuple[float, float]:
        """The best of the points; an extension, the highest density lies near one of them."""
        d = np.array(self.data)
        scores = self.numpy(d)
        return float(d[scores.argmax()]), float(scores.max())

    def sample(self, rng: np.random.Generator, n: int) -> np.ndarray:
        return rng.choice(self.data, n, p=self.shares or None) + rng.normal(0, self.bandwidth, n)

    def mean(self) -> float:
        return float(np.dot(self.data, self._shares()))


@dataclass(frozen=True)
class GammaLeaf(Leaf):
    concentration: float = 1.0
    rate: float = 1.0

    def column(self, x: Column) -> Column:
        return S.log_gamma_pdf(x, self.concentration, self.rate)

    def numpy(self, x: np.ndarray) -> np.ndarray:
        a, b = self.concentration, self.rate
        return np.where(x > 0, a * math.log(b) - math.lgamma(a) + (a - 1) * np.log(np.maximum(x, 1e-300)) - b * x, LOG_ZERO)

    def sql(self, x: str) -> str:
        a, b = self.concentration, self.rate
        return f"CASE WHEN {x} > 0 THEN {_sql(a * math.log(b) - math.lgamma(a))} + {_sql(a - 1)} * ln({x}) - {_sql(b)} * {x} ELSE {_sql(LOG_ZERO)} END"

    def mode(self) -> tuple[float, float]:
        m = max(self.concentration - 1, 1e-6) / self.rate
        return m, float(self.numpy(np.array([m]))[0])

    def sample(self, rng: np.random.Generator, n: int) -> np.ndarray:
        return rng.gamma(self.concentration, 1 / self.rate, n)

    def mean(self) -> float:
        return self.concentration / self.rate


@dataclass(frozen=True)
class BetaLeaf(Leaf):
    alpha: float = 1.0
    beta: float = 1.0

    def column(self, x: Column) -> Column:
        return S.log_beta_pdf(x, self.alpha, self.beta)

    def numpy(self, x: np.ndarray) -> np.ndarray:
        a, b = self.alpha, self.beta
        c = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        inside = (x > 0) & (x < 1)
        y = np.where(inside, x, 0.5)
        return np.where(inside, c + (a - 1) * np.log(y) + (b - 1) * np.log(1 - y), LOG_ZERO)

    def sql(self, x: str) -> str:
        a, b = self.alpha, self.beta
        c = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        return f"CASE WHEN {x} > 0 AND {x} < 1 THEN {_sql(c)} + {_sql(a - 1)} * ln({x}) + {_sql(b - 1)} * ln(1 - {x}) ELSE {_sql(LOG_ZERO)} END"

    def mode(self) -> tuple[float, float]:
        m = min(max((self.alpha - 1) / (self.alpha + self.beta - 2), 1e-6), 1 - 1e-6) if self.alpha + self.beta > 2 else 0.5
        return m, float(self.numpy(np.array([m]))[0])

    def sample(self, rng: np.random.Generator, n: int) -> np.ndarray:
        return rng.beta(self.alpha, self.beta, n)

    def mean(self) -> float:
        return self.alpha / (self.alpha + self.beta)


@dataclass(frozen=True)
class Categorical(Leaf):
    """Probability by position: the value is the index into ``probs``; others have probability 0."""

    probs: tuple[float, ...] = (1.0,)

    def _logs(self) -> list[float]:
        return [math.log(p) if p > 0 else LOG_ZERO for p in self.probs]

    def column(self, x: Column) -> Column:
        logs = F.array(*[S.lit(v) for v in self._logs()])
        return F.when((x >= 0) & (x < len(self.probs)), F.get(logs, x.cast("int"))).otherwise(S.lit(LOG_ZERO))

    def numpy(self, x: np.ndarray) -> np.ndarray:
        i = np.nan_to_num(x).astype(int)
        ok = (i >= 0) & (i < len(self.probs))
        return np.where(ok, np.array(self._logs())[np.clip(i, 0, len(self.probs) - 1)], LOG_ZERO)

    def sql(self, x: str) -> str:
        arms = " ".join(f"WHEN {i} THEN {_sql(v)}" for i, v in enumerate(self._logs()))
        return f"CASE CAST({x} AS INTEGER) {arms} ELSE {_sql(LOG_ZERO)} END"

    def mode(self) -> tuple[float, float]:
        i = int(np.argmax(self.probs))
        return float(i), self._logs()[i]

    def sample(self, rng: np.random.Generator, n: int) -> np.ndarray:
        return rng.choice(len(self.probs), n, p=np.array(self.probs) / sum(self.probs)).astype(float)

    def mean(self) -> float:
        return float(np.dot(range(len(self.probs)), self.probs) / sum(self.probs))


@dataclass(frozen=True)
class PointMass(Leaf):
    value: float = 0.0

    #: Log-probability of any other value.
    ELSEWHERE = -1e20

    def column(self, x: Column) -> Column:
        return F.when(x == self.value, S.lit(0)).otherwise(S.lit(self.ELSEWHERE))

    def numpy(self, x: np.ndarray) -> np.ndarray:
        return np.where(x == self.value, 0.0, self.ELSEWHERE)

    def sql(self, x: str) -> str:
        return f"CASE WHEN {x} = {_sql(self.value)} THEN 0 ELSE {_sql(self.ELSEWHERE)} END"

    def mode(self) -> tuple[float, float]:
        return self.value, 0.0

    def sample(self, rng: np.random.Generator, n: int) -> np.ndarray:
        return np.full(n, self.value)

    def mean(self) -> float:
        return self.value


KINDS: dict[str, type[Leaf]] = {
    "bernoulli": Bernoulli, "poisson": Poisson, "gaussian": Gaussian, "histogram": Histogram, "piecewise": Piecewise, "isotonic": Isotonic,
    "kde": KernelDensity, "gamma": GammaLeaf, "beta": BetaLeaf, "categorical": Categorical, "point": PointMass,
}
#: Other names of leaf families.
ALIASES = {"normal": "gaussian", "gkde": "kde"}


def kind_of(leaf: Leaf) -> str:
    return next(k for k, c in KINDS.items() if type(leaf) is c)
