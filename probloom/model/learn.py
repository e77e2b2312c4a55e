"""Learning the structure and the leaves of a model from a DataFrame.

A slice is a set of rows times a set of columns. Splitting columns gives a
product, splitting rows a sum. All open slices of a level are worked on at once:
one pass for their moments, one for a bounded sample of each, one for the
dependence features, a few for clustering and one that writes the new row
clusters. Each row carries, per column, the slice that owns that cell, so sibling
slices over different columns cluster their rows independently.

That is how slices of more than ``LOCAL_CELLS`` cells are split. A slice within
that bound is sent whole to one task, which learns its part of the model by the
same steps in memory; tasks work on such slices side by side, and only their
models come back. No rows of theirs reach the driver.

What reaches the driver of larger slices is bounded by their number, at most the
rows over the bound: moments, ``SAMPLE`` rows of each (for starts of clusterings,
random choices, distance correlation, medoids and density), ``QUANTILES``
quantiles a column, contingency tables and leaf histograms of at most
``FINE_BINS`` cells.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probloom.model import nodes as N
from probloom.model.leaves import ALIASES, Bernoulli, Categorical, Gaussian, KernelDensity, Leaf, Poisson
from probloom.model.nodes import Node, Product, Sum
from probloom.operators import dependence as D
from probloom.operators.distances import gower_matrix, medoids
from probloom.operators.graphs import above, significant
from probloom.operators.histograms import FINE_BINS, domain_edges, leaf_of
from probloom.operators.metrics import adjusted_mutual_information
from probloom.runtime import freed, stored

#: Rows of a large slice that may reach the driver, most values of a discrete column, rounds of k-means.
SAMPLE, MOST_VALUES, LLOYD = 2000, 2000, 5
#: Cells (rows times columns) of a slice that one task learns in memory.
LOCAL_CELLS = 1_000_000
#: Quantiles that stand for the distribution of a column in a slice of more than SAMPLE rows, most cells of a modal histogram.
QUANTILES, MODAL_CELLS = 2048, 4096

Assign = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Further strategies by name. A row split gets a slice (its sample, features, moments), the feature types and a random generator, and
#: gives a function from rows and their hashes to cluster numbers; a column split gets rows of a slice, its own columns alone, and their
#: types, and gives scores of dependence that are held against the threshold.
ROW_SPLITS: dict[str, Callable[[Slice, Sequence[str], np.random.Generator], Assign]] = {}
COLUMN_SPLITS: dict[str, Callable[[np.ndarray, Sequence[str]], np.ndarray]] = {}


@dataclass(frozen=True)
class Settings:
    """rows: kmeans, rdc_kmeans, random, hyperplane, conditioning, modal, gower, dbscan, poisson or one of ROW_SPLITS;
    columns: rdc, distance, ami, stability, blockwise, none or one of COLUMN_SPLITS; families per column or one for all;
    shape: the nonlinearity of the dependence features."""

    rows: str = "kmeans"
    columns: str = "rdc"
    threshold: float = 0.3
    alpha: float = 0.001
    clusters: int = 2
    min_rows: int = 200
    cluster_first: bool = True
    cluster_univariate: bool = False
    families: tuple[str, ...] | str = "histogram"
    smoothing: float = 1.0
    prior_weight: float = 0.01
    seed: int = 17
    shape: Callable[[np.ndarray], np.ndarray] = np.sin


@dataclass
class Slice:
    no: int
    features: list[int]
    no_clusters: bool = False
    no_independencies: bool = False
    children: list[Slice] = field(default_factory=list)
    kind: str = "open"
    rows: float = 0.0
    moments: tuple | None = None
    sample: np.ndarray | None = None

    @property
    def variances(self) -> np.ndarray:
        n, s, q = self.moments
        return np.maximum(np.diag(q) / n - (s / n) ** 2, 0)


def _owner(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.stack([np.asarray(batch.column(i)) for i in range(d)], 1)
    s = np.stack([np.asarray(batch.column(d + i)) for i in range(d)], 1)
    return x, s, np.asarray(batch.column(2 * d))


def _numbered(base: DataFrame, own: list[str]) -> DataFrame:
    """The rows with a hash ``h`` of their values and their number among equal rows, so that equal rows are drawn one by one.

    Equal rows are counted and written out again by number, in pieces, so many equal rows are never in one task.
    """
    piece = 4096
    rows = base.groupBy(*own).agg(F.count(F.lit(1)).alias("__n")).select(*own, "__n", F.explode(F.expr(f"sequence(0, (__n - 1) div {piece})")).alias("__p"))
    rows = rows.repartition(*own, "__p").select(*own, F.explode(F.expr(f"sequence(__p * {piece}, least(__n, (__p + 1) * {piece}) - 1)")).alias("__i"))
    return rows.select(*own, *[F.lit(0).cast("long").alias(f"s{x[1:]}") for x in own], F.xxhash64(*own, "__i").alias("h"))


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h.astype(np.uint64) % np.uint64(1 << 30)).astype(float) / (1 << 30)


def _pair_counts(c: dict[int, np.ndarray], fs: Sequence[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Distinct code pairs of every pair of features and their counts."""
    for i, f in enumerate(fs):
        for g in fs[i + 1 :]:
            k, n = np.unique(c[f] * WIDE + c[g], return_counts=True)
            yield f, g, k, n


def _table(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Contingency table of code pairs, without empty rows and columns."""
    a, b = (np.unique(v, return_inverse=True)[1] for v in (k // WIDE, k % WIDE))
    out = np.zeros((a.max() + 1, b.max() + 1))
    out[a, b] = n
    return out


#: Greater than any code of a column.
WIDE = 1 << 20


class SparkRows:
    """The rows of slices of any size: columns x0.. (values), s0.. (owning slices) and h (hash)."""

    def __init__(self, data: DataFrame, d: int) -> None:
        self.data, self.d, self.held = data, d, []

    def sums(self, slices: Sequence[Slice], parts: dict[int, Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> dict[int, np.ndarray]:
        """Per slice the sum over its rows of a flat vector of statistics."""
        d, first = self.d, {s.no: s.features[0] for s in slices}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                x, s, h = _owner(b, d)
                for no, f in parts.items():
                    mine = s[:, first[no]] == no
                    if mine.any():
                        v = f(x[mine], h[mine])
                        total[no] = total[no] + v if no in total else v
            for no, v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), no, np.int64)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v.astype(float))], ["no", "i", "v"])

        got = self.data.mapInArrow(run, "no long, i int, v double").groupBy("no", "i").agg(F.sum("v").alias("v")).toPandas()
        out: dict[int, np.ndarray] = {}
        for no, g in got.groupby("no"):
            v = np.zeros(int(g["i"].max()) + 1)
            v[g["i"].to_numpy()] = g["v"].to_numpy()
            out[int(no)] = v
        return out

    def samples(self, slices: Sequence[Slice]) -> None:
        """The ``SAMPLE`` rows of smallest hash of each slice."""
        d, first = self.d, {s.no: s.features[0] for s in slices}
        share = {s.no: min(1.0, (SAMPLE + 6 * math.sqrt(SAMPLE)) / max(s.rows, 1)) for s in slices}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, s, h = _owner(b, d)
                u = _uniform(h)
                for no in share:
                    mine = (s[:, first[no]] == no) & (u < share[no])
                    if mine.any():
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(int(mine.sum()), no, np.int64)), pa.array(h[mine]), pa.FixedSizeListArray.from_arrays(pa.array(x[mine].ravel()), d).cast(pa.list_(pa.float64()))], ["no", "h", "x"])

        got = self.data.mapInArrow(run, "no long, h long, x array<double>").toPandas()
        got["u"] = _uniform(got["h"].to_numpy())
        for s in slices:
            g = got[got["no"] == s.no].sort_values(["u", "h"])["x"].head(SAMPLE)
            s.sample = np.array(g.tolist()).reshape(-1, d)

    def quantiles(self, slices: Sequence[Slice], of: dict[int, list[int]]) -> dict[int, dict[int, tuple[np.ndarray, float, float]]]:
        """Per slice and feature ``QUANTILES`` quantiles, the least and the greatest value of all rows."""
        out: dict[int, dict[int, tuple[np.ndarray, float, float]]] = {}
        cells = [F.when(F.col(f"s{f}") == s.no, F.struct(F.col(f"s{f}").alias("no"), F.lit(f).alias("f"), F.col(f"x{f}").alias("v"))) for s in slices for f in of[s.no]]
        if cells:
            at = [(i + 1) / QUANTILES for i in range(QUANTILES)]
            rows = self.data.select(F.explode(F.array(*cells)).alias("c")).where("c IS NOT NULL").select("c.*")
            for r in rows.groupBy("no", "f").agg(F.percentile_approx("v", at, 20_000).alias("q"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
                out.setdefault(r["no"], {})[r["f"]] = (np.array(r["q"]), r["lo"], r["hi"])
        return out

    def contingency(self, slices: Sequence[Slice], codes: dict[int, dict[int, Callable[[np.ndarray], np.ndarray]]]) -> dict[tuple[int, int, int], np.ndarray]:
        """Per slice and pair of its features the table of counts over all rows."""
        d, owner = self.d, {s.no: s.features for s in slices}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, s, _ = _owner(b, d)
                for no, fs in owner.items():
                    mine = s[:, fs[0]] == no
                    if mine.any():
                        for f, g, k, n in _pair_counts({f: codes[no][f](x[mine, f]).astype(np.int64) for f in fs}, fs):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), v, np.int64)) for v in (no, f, g)] + [pa.array(k), pa.array(n.astype(np.int64))], ["no", "f", "g", "k", "n"])

        got = self.data.mapInArrow(run, "no long, f long, g long, k long, n long").groupBy("no", "f", "g", "k").agg(F.sum("n").alias("n")).toPandas()
        return {key: _table(t["k"].to_numpy(), t["n"].to_numpy()) for key, t in got.groupby(["no", "f", "g"])}

    def stability(self, part: dict[int, list[int]]) -> dict[int, np.ndarray]:
        own = {f"x{f}": f"s{f}" for f in range(self.d)}
        return D.stability_over_rows(self.data, {no: [f"x{f}" for f in fs] for no, fs in part.items()}, ["h", *[f"x{f}" for f in range(self.d)]], own)

    def products(self, moves: dict[int, dict[int, int]]) -> None:
        """Cells of the slices go to the slice named for their column."""
        to = {f"s{f}": [(no, m[f]) for no, m in moves.items() if f in m] for f in range(self.d)}
        self.data = self.data.withColumns({k: F.expr(f"CASE {k} " + " ".join(f"WHEN {a} THEN {b}" for a, b in v) + f" ELSE {k} END") for k, v in to.items() if v})

    def split(self, slices: Sequence[Slice], assign: dict[int, Assign], renumber: dict[int, dict[int, int]]) -> None:
        """Write the clusters of all slices at once."""
        d, cols, names = self.d, {s.no: s.features for s in slices}, [f.name for f in self.data.schema]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, s, h = _owner(b, d)
                new = s.copy()
                for no, to in renumber.items():
                    mine = np.nonzero(s[:, cols[no][0]] == no)[0]
                    if len(mine):
                        a = _renamed(assign[no](x[mine], h[mine]), to)
                        for f in cols[no]:
                            new[mine, f] = a
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(d)], *[pa.array(new[:, i]) for i in range(d)], b.column(2 * d)], names)

        self.data = self.data.mapInArrow(run, self.data.schema)

    def held_of(self, s: Slice) -> np.ndarray:
        """The rows that are at hand: the sample."""
        return s.sample

    def settle(self) -> None:
        """Write the rows where the level ends, and drop those of the level before."""
        self.data = stored(self.data, "slices")
        freed(*self.held)
        self.held = [self.data]


class LocalRows:
    """The rows of slices that one task holds in memory."""

    def __init__(self, x: np.ndarray, h: np.ndarray, root: int) -> None:
        self.x, self.h, self.at = x, h, {root: np.argsort(h, kind="stable")}

    def sums(self, slices: Sequence[Slice], parts: dict[int, Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> dict[int, np.ndarray]:
        return {no: f(self.x[self.at[no]], self.h[self.at[no]]) for no, f in parts.items()}

    def samples(self, slices: Sequence[Slice]) -> None:
        for s in slices:
            at = self.at[s.no]
            s.sample = self.x[at[np.argsort(_uniform(self.h[at]), kind="stable")[:SAMPLE]]]

    def quantiles(self, slices: Sequence[Slice], of: dict[int, list[int]]) -> dict[int, dict[int, tuple[np.ndarray, float, float]]]:
        out: dict[int, dict[int, tuple[np.ndarray, float, float]]] = {}
        for s in slices:
            for f in of[s.no]:
                v = np.sort(self.x[self.at[s.no], f])
                q = v if len(v) <= SAMPLE else v[np.ceil(np.arange(1, QUANTILES + 1) / QUANTILES * len(v)).astype(int) - 1]
                out.setdefault(s.no, {})[f] = (q, v[0], v[-1])
        return out

    def contingency(self, slices: Sequence[Slice], codes: dict[int, dict[int, Callable[[np.ndarray], np.ndarray]]]) -> dict[tuple[int, int, int], np.ndarray]:
        return {(s.no, f, g): _table(k, n) for s in slices for f, g, k, n in _pair_counts({f: codes[s.no][f](self.x[self.at[s.no], f]).astype(np.int64) for f in s.features}, s.features)}

    def stability(self, part: dict[int, list[int]]) -> dict[int, np.ndarray]:
        return {no: D.stability_pvalues(self.x[np.ix_(self.at[no], fs)]) for no, fs in part.items()}

    def products(self, moves: dict[int, dict[int, int]]) -> None:
        for no, to in moves.items():
            own = self.at.pop(no)
            self.at.update(dict.fromkeys(to.values(), own))

    def split(self, slices: Sequence[Slice], assign: dict[int, Assign], renumber: dict[int, dict[int, int]]) -> None:
        for no, to in renumber.items():
            own = self.at.pop(no)
            a = _renamed(assign[no](self.x[own], self.h[own]), to)
            self.at.update({t: own[a == t] for t in to.values()})

    def held_of(self, s: Slice) -> np.ndarray:
        """The rows that are at hand: all."""
        return self.x[self.at[s.no]]

    def settle(self) -> None:
        pass


def _renamed(clusters: np.ndarray, to: dict[int, int]) -> np.ndarray:
    table = np.zeros(max(to) + 1, np.int64)
    table[list(to)] = list(to.values())
    return table[clusters.astype(int)]


def _operation(s: Slice, root: bool, c: Settings) -> str:
    """What to do with a slice; the first rule that holds."""
    families = c.families if isinstance(c.families, tuple) else (c.families,)
    if len(s.features) == 1:
        big = c.cluster_univariate and "isotonic" in families and s.rows > c.min_rows and not s.no_clusters and not s.no_independencies
        return "rows" if big else "leaf"
    flat = int((s.variances[s.features] <= 0).sum())
    if flat > 1:  # a single constant column is left to the splits
        return "naive" if flat == len(s.features) else "constant"
    if s.rows <= c.min_rows or (s.no_clusters and s.no_independencies):
        return "naive"
    if s.no_independencies:
        return "rows"
    if s.no_clusters:
        return "columns"
    if root:
        return "rows" if c.cluster_first else "columns"
    return "columns"


# --- column splits -----------------------------------------------------------


def _column_groups(rows: SparkRows | LocalRows, slices: list[Slice], kinds: Sequence[str], domains: Sequence[np.ndarray], c: Settings) -> dict[int, list[int]]:
    """Component of each feature of each slice."""
    if c.columns == "none":
        return {s.no: [1] * len(s.features) for s in slices}
    if c.columns == "rdc":
        grids = {no: {f: q[0] for f, q in v.items()} for no, v in rows.quantiles(slices, {s.no: s.features for s in slices}).items()}
        parts, size = {}, {}
        for s in slices:
            codes = {f: domains[f] if kinds[f] == "categorical" else None for f in s.features}
            size[s.no] = D.feature_count([1 if v is None else len(v) for v in codes.values()])

            def moments(x: np.ndarray, _: np.ndarray, s=s, codes=codes, k=size[s.no]) -> np.ndarray:
                z = np.hstack([D.nonlinear(x[:, f], grids[s.no][f], 42 + f, k, codes[f], c.shape) for f in s.features])
                return np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])

            parts[s.no] = moments
        got, out = rows.sums(slices, parts), {}
        for s in slices:
            v, m = got[s.no], len(s.features) * size[s.no]
            out[s.no] = above(D.rdc_from_moments(v[0], v[1 : m + 1], v[m + 1 :].reshape(m, m), len(s.features), size[s.no]), c.threshold)
        return out
    if c.columns == "distance":
        ranked = lambda x: np.column_stack([D.ranks(v, np.sort(v)) for v in x.T])
        return {s.no: above(D.distance_matrix(ranked(rows.held_of(s)[:, s.features])), c.threshold) for s in slices}
    if c.columns in COLUMN_SPLITS:
        return {s.no: above(COLUMN_SPLITS[c.columns](rows.held_of(s)[:, s.features], [kinds[f] for f in s.features]), c.threshold) for s in slices}
    if c.columns == "ami":
        codes: dict[int, dict[int, Callable]] = {}
        grids = rows.quantiles(slices, {s.no: [f for f in s.features if kinds[f] == "continuous"] for s in slices})
        for s in slices:
            codes[s.no] = {}
            for f in s.features:
                low = float(domains[f][0])
                codes[s.no][f] = lambda x, low=low: x - low
                if kinds[f] == "continuous":
                    q, lo, hi = grids[s.no][f]
                    edges = np.linspace(lo, hi, _cells(q, lo, hi, s.rows, WIDE - 1) + 1)[1:-1]
                    codes[s.no][f] = lambda x, edges=edges: np.digitize(x, edges)
        tables = rows.contingency(slices, codes)
        out = {}
        for s in slices:
            m = np.eye(len(s.features))
            for i, f in enumerate(s.features):
                for j in range(i + 1, len(s.features)):
                    m[i, j] = m[j, i] = adjusted_mutual_information(tables[s.no, f, s.features[j]])
            out[s.no] = above(m, c.threshold)
        return out
    if c.columns not in ("stability", "blockwise"):
        raise ValueError(f"unknown column split {c.columns!r}")
    blocks = {s.no: D.overlapping_blocks(len(s.features)) if c.columns == "blockwise" else [list(range(len(s.features)))] for s in slices}
    found: dict[int, list[np.ndarray]] = {s.no: [] for s in slices}
    for b in range(max(map(len, blocks.values()))):
        part = {s.no: [s.features[i] for i in blocks[s.no][b]] for s in slices if b < len(blocks[s.no])}
        for no, p in rows.stability(part).items():
            found[no].append(p)
    out = {}
    for s in slices:
        p = D.blockwise_median(len(s.features), blocks[s.no], found[s.no])
        out[s.no] = significant(np.minimum(p, p.T), c.alpha)
    return out


def _cells(q: np.ndarray, lo: float, hi: float, n: float, most: int) -> int:
    """Freedman-Diaconis cells of a column of ``n`` rows from its quantiles."""
    iqr = np.subtract(*np.percentile(q, [75, 25]))
    return max(1, min(most, math.ceil((hi - lo) / (2 * iqr / n ** (1 / 3))))) if iqr > 0 else 1


# --- row splits ---------------------------------------------------------------


def _scale(s: Slice, kinds: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    n, total, _ = s.moments
    sd = np.sqrt(s.variances)
    return (total / n)[s.features], np.where(sd > 0, sd, 1)[s.features]


def _encoder(s: Slice, kinds: Sequence[str], domains: Sequence[np.ndarray], grids: dict[int, np.ndarray] | None = None, shape: Callable = np.sin) -> Callable[[np.ndarray], np.ndarray]:
    """Coordinates for clustering: z-scores and indicators of categories, or dependence features."""
    if grids is not None:
        codes = {f: domains[f] if kinds[f] == "categorical" else None for f in s.features}
        k = D.feature_count([1 if v is None else len(v) for v in codes.values()])
        return lambda x: np.hstack([D.nonlinear(x[:, f], grids[f], 42 + f, k, codes[f], shape) for f in s.features])
    mean, sd = _scale(s, kinds)
    values = {f: domains[f] for f in s.features if kinds[f] == "categorical"}

    def run(x: np.ndarray) -> np.ndarray:
        return np.hstack([(x[:, f, None] == values[f][None]).astype(float) if f in values else ((x[:, f] - mean[i]) / sd[i])[:, None] for i, f in enumerate(s.features)])

    return run


def _nearest(centres: np.ndarray, z: np.ndarray) -> np.ndarray:
    return ((z[:, None] - centres[None]) ** 2).sum(2).argmin(1)


def _start_centres(z: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = [z[int(rng.integers(len(z)))]]
    while len(centres) < k:
        far = np.min([((z - c) ** 2).sum(1) for c in centres], axis=0) + 1e-12
        centres.append(z[rng.choice(len(z), p=far / far.sum())])
    return np.array(centres)


def dbscan(z: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Clusters of a small sample by density; -1 is noise."""
    near = ((z[:, None] - z[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    label = np.full(len(z), -1)
    for i in np.nonzero(core)[0]:
        if label[i] >= 0:
            continue
        queue, label[i] = [i], label.max() + 1
        while queue:
            j = queue.pop()
            for k in np.nonzero(near[j] & (label < 0))[0]:
                label[k] = label[i]
                if core[k]:
                    queue.append(k)
    return label


def _valleys(rows: SparkRows | LocalRows, slices: list[Slice], rngs: dict[int, np.random.Generator]) -> dict[int, tuple[int, float]]:
    """A random feature of each slice and the middle of a random valley of its histogram over all rows, else a random value."""
    chosen = {s.no: int(rngs[s.no].choice(s.features)) for s in slices}
    grids, edges = rows.quantiles(slices, {no: [f] for no, f in chosen.items()}), {}
    for s in slices:
        q, lo, hi = grids[s.no][chosen[s.no]]
        cells = _cells(q, lo, hi, s.rows, MODAL_CELLS) if len(np.unique(q)) > 20 else 10
        edges[s.no] = np.linspace(lo, hi if hi > lo else lo + 1, cells + 1)
    got = rows.sums(slices, {no: (lambda x, _, f=f, e=edges[no]: np.histogram(x[:, f], e)[0].astype(float)) for no, f in chosen.items()})
    out = {}
    for s in slices:
        n, e, rng = got[s.no], edges[s.no], rngs[s.no]
        low = [i for i in range(1, len(n) - 1) if n[i] < n[i - 1] and n[i] < n[i + 1]]
        v = float((e[low] + e[np.array(low) + 1])[int(rng.integers(len(low)))] / 2) if low else float(rng.choice(s.sample[:, chosen[s.no]]))
        out[s.no] = (chosen[s.no], v)
    return out


def _assigners(rows: SparkRows | LocalRows, slices: list[Slice], kinds: Sequence[str], domains: Sequence[np.ndarray], c: Settings) -> dict[int, Assign]:
    """For each slice a function from its rows (and their hashes) to clusters."""
    out: dict[int, Assign] = {}
    lloyd: dict[int, tuple[Callable, np.ndarray]] = {}
    rngs = {s.no: np.random.default_rng([c.seed, s.no]) for s in slices}
    grids = rows.quantiles(slices, {s.no: s.features for s in slices}) if c.rows == "rdc_kmeans" else {}
    valley = _valleys(rows, slices, rngs) if c.rows == "modal" else {}
    for s in slices:
        rng = rngs[s.no]
        x, fs = s.sample, s.features
        if c.rows in ("kmeans", "rdc_kmeans"):
            enc = _encoder(s, kinds, domains, {f: q[0] for f, q in grids[s.no].items()} if c.rows == "rdc_kmeans" else None, c.shape)
            lloyd[s.no] = (enc, _start_centres(enc(x), c.clusters, rng))
        elif c.rows == "random":
            out[s.no] = lambda x, h: (h >> 7) & 1
        elif c.rows == "hyperplane":
            plane = rng.uniform(-1, 1, len(fs))
            mean = _scale(s, kinds)[0]
            out[s.no] = lambda x, h, fs=fs, plane=plane / np.linalg.norm(plane), mean=mean: ((x[:, fs] - mean) @ plane > 0).astype(int)
        elif c.rows == "conditioning":
            f = int(rng.choice(fs))
            v = float(rng.choice(x[:, f]))
            out[s.no] = (lambda x, h, f=f, v=v: (x[:, f] <= v).astype(int)) if kinds[f] == "continuous" else (lambda x, h, f=f, v=v: (x[:, f] == v).astype(int))
        elif c.rows == "modal":
            f, v = valley[s.no]
            out[s.no] = lambda x, h, f=f, v=v: (x[:, f] <= v).astype(int)
        elif c.rows == "gower":
            some = x[:600][:, fs]
            kind, span = [kinds[f] for f in fs], np.ptp(some, axis=0)
            centre = some[medoids(gower_matrix(some, some, kind, span), c.clusters)]
            out[s.no] = lambda x, h, fs=fs, centre=centre, kind=kind, span=span: gower_matrix(x[:, fs], centre, kind, span).argmin(1)
        elif c.rows == "dbscan":
            enc = _encoder(s, kinds, domains)
            z = enc(x[:1000])
            label = dbscan(z, 0.3 * math.sqrt(z.shape[1]), 10)
            out[s.no] = lambda x, h, enc=enc, z=z, label=label: (lambda q: np.concatenate([label[((q[i : i + 512, None] - z[None]) ** 2).sum(2).argmin(1)] for i in range(0, len(q), 512)]) + 1)(enc(x))
        elif c.rows == "poisson":
            from probloom.model.networks import mixture_assigner

            out[s.no] = mixture_assigner(x[:, fs], fs, c.clusters, rng)
        elif c.rows in ROW_SPLITS:
            out[s.no] = ROW_SPLITS[c.rows](s, kinds, rng)
        else:
            raise ValueError(f"unknown row split {c.rows!r}")
    for _ in range(LLOYD if lloyd else 0):

        def step(no: int) -> Callable:
            enc, centres = lloyd[no]

            def run(x: np.ndarray, _: np.ndarray) -> np.ndarray:
                z = enc(x)
                a = _nearest(centres, z)
                return np.concatenate([np.bincount(a, minlength=len(centres)), np.stack([z[a == j].sum(0) for j in range(len(centres))]).ravel()])

            return run

        got = rows.sums(slices, {no: step(no) for no in lloyd})
        for no, v in got.items():
            enc, centres = lloyd[no]
            k = len(centres)
            n, total = v[:k], v[k:].reshape(centres.shape)
            lloyd[no] = (enc, np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres))
    for no, (enc, centres) in lloyd.items():
        out[no] = lambda x, h, enc=enc, centres=centres: _nearest(centres, enc(x))
    return out


def _split_rows(rows: SparkRows | LocalRows, slices: list[Slice], assign: dict[int, Assign], new_no: Callable[[], int], c: Settings) -> None:
    """Give the clusters of all slices their numbers; a slice that stays in one piece is marked."""
    counts = rows.sums(slices, {no: (lambda x, h, f=f: np.bincount(f(x, h).astype(int), minlength=SAMPLE + 1).astype(float)) for no, f in assign.items()})  # no more clusters than sampled rows
    renumber: dict[int, dict[int, int]] = {}
    for s in slices:
        used = [i for i, n in enumerate(counts[s.no]) if n > 0]
        if len(used) < 2:
            s.no_clusters = True
            s.kind = "again"
            continue
        s.kind = "sum"
        renumber[s.no] = {}
        for i in used:
            child = Slice(new_no(), list(s.features), rows=float(counts[s.no][i]))
            renumber[s.no][i] = child.no
            s.children.append(child)
    if renumber:
        rows.split(slices, assign, renumber)


# --- leaves -------------------------------------------------------------------


def _fit_leaves(rows: SparkRows | LocalRows, found: list[Slice], kinds: Sequence[str], families: Sequence[str], domains: list[np.ndarray], c: Settings) -> dict[int, Leaf]:
    """One pass of bin counts and moments for all leaves."""
    edges: dict[int, np.ndarray] = {}
    for f in {s.features[0] for s in found}:
        dom = domains[f]
        if kinds[f] == "continuous":
            edges[f] = dom
        else:
            edges[f] = np.array(domain_edges(float(dom.min()), float(dom.max()), 1.0, families[f] in ("histogram", "categorical")))

    def counts(f: int) -> Callable:
        e = edges[f]

        def run(x: np.ndarray, _: np.ndarray) -> np.ndarray:
            v = x[:, f]
            i = np.clip(np.searchsorted(e, v, side="right") - 1, 0, len(e) - 2)
            return np.concatenate([[len(v), v.sum(), (v * v).sum()], np.bincount(i, minlength=len(e) - 1)])

        return run

    got = rows.sums(found, {s.no: counts(s.features[0]) for s in found}) if found else {}
    out: dict[int, Leaf] = {}
    for s in found:
        f, v = s.features[0], got[s.no]
        n, mean = v[0], v[1] / v[0]
        var = max(v[2] / n - mean * mean, 0.0)
        family = ALIASES.get(families[f], families[f])
        if family == "baseline":
            family = "gaussian" if kinds[f] == "continuous" else "categorical"
        if family == "gaussian":
            out[s.no] = Gaussian(f, mean, max(math.sqrt(var), 0.4))
        elif family == "poisson":
            out[s.no] = Poisson(f, max(mean, 1e-15))
        elif family == "bernoulli":
            out[s.no] = Bernoulli(f, min(max(mean, 0.0), 1.0))
        elif family == "categorical":
            probs = (v[3:] + c.smoothing) / (n + c.smoothing * len(v[3:]))
            pad = int(domains[f].min())  # the value is the position
            out[s.no] = Categorical(f, (0.0,) * max(pad, 0) + tuple(map(float, probs)))
        elif family == "kde":
            full = np.nonzero(v[3:])[0]  # cells with rows: their middles, or the whole numbers, weighted by all rows
            at = (edges[f][full] + edges[f][full + 1]) / 2 if kinds[f] == "continuous" else domains[f].min() + full
            out[s.no] = KernelDensity(f, tuple(map(float, at)), 0.2, 1 / max(float(np.ptp(domains[f])), 1e-9), c.prior_weight, tuple(map(float, v[3:][full] / n)))
        else:
            out[s.no] = leaf_of(f, family, kinds[f], v[3:], edges[f], float(domains[f][0]), float(domains[f][-1]), c.smoothing, c.prior_weight, var)
    return out


def learn(df: DataFrame, columns: Sequence[str], kinds: Sequence[str], settings: Settings | None = None) -> Node:
    """Learn a model of ``columns``; feature i is column i.

    Rows with a NULL or NaN in any of them are left out. Discrete and
    categorical columns hold whole numbers. Without rows, or without columns,
    there is no model and a ValueError is raised; a single column gives a leaf.
    """
    c, d = settings or Settings(), len(columns)
    families = list(c.families) if isinstance(c.families, tuple) else [c.families] * d
    base = df.select(*[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(columns)])
    base = base.where(" AND ".join(f"x{i} IS NOT NULL AND NOT isnan(x{i})" for i in range(d)) or "false")
    own = [f"x{i}" for i in range(d)]
    if not d:
        raise ValueError("nothing to learn from")
    data = stored(_numbered(base, own), "slices")
    ranks = [i * 2 / FINE_BINS for i in range(1, FINE_BINS // 2)]
    limits = data.agg(F.count(F.lit(1)).alias("n"), *[F.min(x).alias(f"{x}_lo") for x in own], *[F.max(x).alias(f"{x}_hi") for x in own], *[F.percentile_approx(x, ranks, 10_000).alias(f"{x}_q") for x in own]).first()
    if not limits["n"]:
        raise ValueError("nothing to learn from")
    domains = []
    for i, x in enumerate(own):
        lo, hi = limits[f"{x}_lo"], limits[f"{x}_hi"]
        if kinds[i] != "continuous" and hi - lo > MOST_VALUES:
            raise ValueError(f"{columns[i]} spans more than {MOST_VALUES} values; declare it continuous")
        if kinds[i] == "continuous":  # a grid even in width and in rows, so that far values don't put all others into one cell
            even, ranked = np.linspace(lo, hi if hi > lo else lo + 1e-6, FINE_BINS // 2 + 1), limits[f"{x}_q"]
            domains.append(np.unique(np.concatenate([even, ranked])))
        else:
            domains.append(np.arange(lo, hi + 1))
    root = Slice(0, list(range(d)), rows=float(limits["n"]))
    rows = SparkRows(data, d)
    local = _grow(rows, root, True, d, kinds, families, domains, c, LOCAL_CELLS)
    models = _in_tasks(rows.data, d, local, root, kinds, families, domains, c)
    model = N.prune(_built(root, _fit_leaves(rows, _leaves(root), kinds, families, domains, c), models))
    freed(data, *rows.held)
    if not isinstance(model, Leaf):
        N.validate(model)
    return model


def _leaves(s: Slice) -> list[Slice]:
    return [s] if s.kind == "leaf" else [x for child in s.children for x in _leaves(child)]


def _built(s: Slice, leaves: dict[int, Leaf], models: dict[int, Node]) -> Node:
    if s.kind == "local":
        return models[s.no]
    if s.kind == "leaf":
        return leaves[s.no]
    kids = tuple(_built(x, leaves, models) for x in s.children)
    if s.kind == "product":
        return Product(kids)
    total = sum(x.rows for x in s.children)
    return Sum(tuple(x.rows / total for x in s.children), kids)


def _in_tasks(data: DataFrame, d: int, local: list[Slice], root: Slice, kinds: Sequence[str], families: Sequence[str], domains: list[np.ndarray], c: Settings) -> dict[int, Node]:
    """The models of slices within the bound, each learned by one task from its rows."""
    if not local:
        return {}
    state = {s.no: (s.features, s.no_clusters, s.no_independencies, s is root) for s in local}
    first = np.full((max(state) + 1,), -1)
    for no, (fs, *_) in state.items():
        first[no] = fs[0]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each slice that owns cells of a row."""
        for b in batches:
            x, s, h = _owner(b, d)
            for f in range(d):
                mine = np.nonzero((s[:, f] < len(first)) & (first[np.minimum(s[:, f], len(first) - 1)] == f))[0]
                if len(mine):
                    yield pa.RecordBatch.from_arrays([pa.array(s[mine, f]), pa.array(h[mine]), pa.FixedSizeListArray.from_arrays(pa.array(x[mine].ravel()), d).cast(pa.list_(pa.float64()))], ["no", "h", "x"])

    more = dict(ROW_SPLITS), dict(COLUMN_SPLITS)  # a task's process has only the module's own

    def work(group: pa.Table) -> pa.Table:
        from probloom.model import learn as own_module

        own_module.ROW_SPLITS.update(more[0])
        own_module.COLUMN_SPLITS.update(more[1])
        no = group["no"][0].as_py()
        features, no_clusters, no_independencies, is_root = state[no]
        x = np.concatenate([v.flatten().to_numpy(zero_copy_only=False) for v in group["x"].chunks]).reshape(-1, d)
        own = Slice(no, features, no_clusters, no_independencies, rows=float(len(x)))
        rows = LocalRows(x, np.asarray(group["h"]), no)
        _grow(rows, own, is_root, d, kinds, families, domains, c, 0)
        return pa.table({"no": [no], "model": pa.array([pickle.dumps(_built(own, _fit_leaves(rows, _leaves(own), kinds, families, domains, c), {}))], pa.binary())})

    got = data.mapInArrow(send, "no long, h long, x array<double>").groupBy("no").applyInArrow(work, "no long, model binary").collect()  # models, no rows
    return {r["no"]: pickle.loads(r["model"]) for r in got}


def _grow(rows: SparkRows | LocalRows, root: Slice, whole: bool, d: int, kinds: Sequence[str], families: Sequence[str], domains: list[np.ndarray], c: Settings, bound: int) -> list[Slice]:
    """Split ``root`` level by level until leaves are left; slices of at most ``bound`` cells are set aside and returned."""
    level, last, aside = [root], [root.no], []

    def new_no() -> int:
        last[0] += 1
        return last[0]

    def moments(x: np.ndarray, _: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])

    while True:
        for s in level:
            if s.rows * len(s.features) <= bound:
                s.kind = "local"
                aside.append(s)
        level = [s for s in level if s.kind != "local"]
        if not level:
            return aside
        got = rows.sums(level, {s.no: moments for s in level})
        for s in level:
            v = got[s.no]
            s.rows, s.moments = v[0], (v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d))
        rows.samples(level)
        todo: dict[str, list[Slice]] = {}
        for s in level:
            op = _operation(s, whole and s is root, c)
            if len(s.sample) < 2 and op in ("rows", "columns"):
                op = "naive" if len(s.features) > 1 else "leaf"
            todo.setdefault(op, []).append(s)
        for s in todo.get("leaf", []):
            s.kind = "leaf"
        split: dict[int, list[list[int]]] = {s.no: [[f] for f in s.features] for s in todo.get("naive", [])}
        for s in todo.get("constant", []):
            flat = [f for f in s.features if s.variances[f] <= 0]
            split[s.no] = [*[[f] for f in flat], [f for f in s.features if f not in flat]]
        pending: list[Slice] = []
        if todo.get("columns"):
            for no, labels in _column_groups(rows, todo["columns"], kinds, domains, c).items():
                s = next(x for x in todo["columns"] if x.no == no)
                if len(set(labels)) < 2:
                    s.no_independencies = True
                    pending.append(s)
                else:
                    split[no] = [[f for f, k in zip(s.features, labels) if k == g] for g in sorted(set(labels))]
        moves: dict[int, dict[int, int]] = {}
        nxt: list[Slice] = []
        for s in level:
            if s.no in split:
                s.kind = "product"
                for group in split[s.no]:
                    child = Slice(new_no(), group, rows=s.rows, no_clusters=s in todo.get("constant", []) and len(group) == 1)
                    s.children.append(child)
                    moves.setdefault(s.no, {}).update(dict.fromkeys(group, child.no))
                    if len(group) == 1:
                        child.kind, child.sample = "leaf", s.sample
                    else:
                        nxt.append(child)
        if moves:
            rows.products(moves)
        if todo.get("rows"):
            _split_rows(rows, todo["rows"], _assigners(rows, todo["rows"], kinds, domains, c), new_no, c)
            for s in todo["rows"]:
                if s.kind == "again":
                    s.kind = "open"
                    pending.append(s)
                else:
                    nxt += s.children
        if moves or todo.get("rows"):
            rows.settle()
        for s in level:
            if s.kind != "leaf":
                s.sample = None  # nothing of a finished level stays
        level = nxt + pending
