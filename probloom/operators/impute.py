"""Filling missing values from similar records.

A mixture of Gaussian-categorical components describes the records: within a
component the numeric fields are jointly normal (full covariance) and each
categorical field has its own table. Fitting is expectation-maximisation with
missing cells: every task reduces its rows to sufficient statistics, which are
summed in the shuffle, so the driver sees one small set of sums a round whatever
the number of rows. A missing number is filled by its conditional expectation, a
missing code by its conditional mode.

Similar means: of the same group first. Numeric fields are centred on the mean
of their group (shrunk to the overall mean where the group is small), and each
group has its own component weights when cells are filled.

The start is fitted to the end on ``START_ROWS`` rows of smallest hash; then
rounds over all rows follow until the log-likelihood gains less than
``TOLERANCE`` of itself. The group statistics and the filling cover all rows.

Rows are taken by the pattern of their missing cells: sums over the observed
cells of a pattern are enough, as the expectations of the missing ones are linear
in them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from probloom.runtime import beside, stored
from probloom.schema import Feature, known

#: Rows of the start, weight of the overall mean and weights against a group's own, least variance in units of the field's.
START_ROWS, GROUP_PRIOR, RIDGE = 4096, 20.0, 1e-3
COMPONENTS, TOLERANCE = 6, 1e-4


@dataclass
class Mixture:
    """Weights (k), means (k, d), covariances (k, d, d) and one table (k, codes) per categorical field; rounds over all rows and the last gain."""

    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    tables: list[np.ndarray] = field(default_factory=list)
    rounds: int = 0
    gain: float = math.inf


@dataclass
class Pattern:
    """The rows that miss the same numbers: observed and missing fields, rows less each mean, and the regression of the missing on the observed."""

    rows: np.ndarray
    seen: np.ndarray
    gone: np.ndarray
    off: np.ndarray  # (k, rows, seen)
    gain: np.ndarray  # (k, gone, seen)
    rest: np.ndarray  # (k, gone, gone), the covariance left


def log_joint(m: Mixture, x: np.ndarray, cats: np.ndarray, prior: np.ndarray | None = None) -> tuple[np.ndarray, list[Pattern]]:
    """Log density of the observed cells per row and component, and the patterns of the rows. NaN marks a missing number, -1 a missing code."""
    n, d = x.shape
    ll = np.log(np.maximum(m.weights if prior is None else prior, 1e-300)) + np.zeros((n, len(m.weights)))
    gone = np.isnan(x)
    patterns = []
    code = gone @ (1 << np.arange(d)) if d else np.zeros(n, int)
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, np.nonzero(np.diff(code[order]))[0] + 1) if n else []:
        o, u = np.nonzero(~gone[rows[0]])[0], np.nonzero(gone[rows[0]])[0]
        off = x[np.ix_(rows, o)][None] - m.means[:, None, o]
        root = np.linalg.cholesky(m.covs[:, o[:, None], o])
        back = np.linalg.inv(root)
        white = off @ back.transpose(0, 2, 1)
        ll[rows] -= 0.5 * ((white * white).sum(2) + (2 * np.log(np.diagonal(root, axis1=1, axis2=2)).sum(1) + len(o) * math.log(2 * math.pi))[:, None]).T
        across = m.covs[:, u[:, None], o]
        gain = across @ (back.transpose(0, 2, 1) @ back)
        patterns.append(Pattern(rows, o, u, off, gain, m.covs[:, u[:, None], u] - gain @ across.transpose(0, 2, 1)))
    for c, table in enumerate(m.tables):
        seen = cats[:, c] >= 0
        ll[seen] += np.log(np.maximum(table[:, cats[seen, c]].T, 1e-300))
    return ll, patterns


def expected(m: Mixture, x: np.ndarray, r: np.ndarray, patterns: list[Pattern]) -> np.ndarray:
    """The rows with their missing numbers at the conditional expectation."""
    out = x.copy()
    for p in patterns:
        if len(p.gone):
            fill = m.means[:, None, p.gone] + p.off @ p.gain.transpose(0, 2, 1)
            out[np.ix_(p.rows, p.gone)] = np.einsum("nk,knu->nu", r[p.rows], fill)
    return out


def responsibilities(ll: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = ll.max(1, keepdims=True) if len(ll) else np.zeros((0, 1))
    r = np.exp(ll - top)
    total = r.sum(1, keepdims=True)
    return r / total, (top + np.log(total))[:, 0]


def statistics(m: Mixture, x: np.ndarray, cats: np.ndarray) -> np.ndarray:
    """Sums of one batch: log-likelihood, rows, weights, first and second moments about the means, code counts; flat."""
    ll, patterns = log_joint(m, x, cats)
    r, logs = responsibilities(ll)
    k, d = m.means.shape
    first, second = np.zeros((k, d)), np.zeros((k, d, d))  # about the means
    for p in patterns:
        w = r[p.rows].T
        one = (w[:, None] @ p.off)[:, 0]
        two = (p.off * w[:, :, None]).transpose(0, 2, 1) @ p.off
        o, u = p.seen, p.gone
        first[:, o] += one
        second[:, o[:, None], o] += two
        if len(u):
            first[:, u] += (p.gain @ one[:, :, None])[:, :, 0]
            mixed = p.gain @ two
            second[:, u[:, None], o] += mixed
            second[:, o[:, None], u] += mixed.transpose(0, 2, 1)
            second[:, u[:, None], u] += mixed @ p.gain.transpose(0, 2, 1) + w.sum(1)[:, None, None] * p.rest
    out = [np.array([logs.sum(), len(x)]), r.sum(0), first.ravel(), second.ravel()]
    for c, table in enumerate(m.tables):
        counts = np.zeros_like(table)
        for v in range(table.shape[1]):
            counts[:, v] = r[cats[:, c] == v].sum(0)
        counts += r[cats[:, c] < 0].sum(0)[:, None] * table
        out.append(counts.ravel())
    return np.concatenate(out)


def updated(m: Mixture, sums: np.ndarray) -> Mixture:
    """Maximisation from the sums of all rows."""
    k, d = m.means.shape
    at = 2
    w = np.maximum(sums[at : at + k], 1e-9)
    at += k
    first = sums[at : at + k * d].reshape(k, d)
    at += k * d
    second = sums[at : at + k * d * d].reshape(k, d, d)
    at += k * d * d
    step = first / w[:, None]
    means = m.means + step
    covs = second / w[:, None, None] - step[:, :, None] * step[:, None, :]
    # A weak prior of unit variance keeps thin components regular.
    covs = (covs * w[:, None, None] + np.eye(d)) / (w + 1)[:, None, None] + RIDGE * np.eye(d)
    tables = []
    for t in m.tables:
        counts = sums[at : at + t.size].reshape(t.shape) + 0.5
        at += t.size
        tables.append(counts / counts.sum(1, keepdims=True))
    return Mixture(w / w.sum(), means, covs, tables)


def start(x: np.ndarray, cats: np.ndarray, codes: list[int], k: int) -> Mixture:
    """Centres far apart among the rows given, then a few rounds on them."""
    d = x.shape[1]
    filled = np.where(np.isnan(x), 0.0, x)
    seed = np.random.default_rng(5)
    centres = [filled[0] if len(filled) else np.zeros(d)]
    while len(centres) < k:
        if not len(filled):
            centres.append(seed.standard_normal(d))
            continue
        far = np.min([((filled - c) ** 2).sum(1) for c in centres], axis=0) + 1e-12
        centres.append(filled[seed.choice(len(filled), p=far / far.sum())])
    m = Mixture(np.full(k, 1 / k), np.array(centres).reshape(k, d), np.stack([np.eye(d)] * k), [np.full((k, c), 1 / c) for c in codes])
    last = -math.inf
    while len(x):
        sums = statistics(m, x, cats)
        m = updated(m, sums)
        if not abs(sums[0] - last) > 0.1 * TOLERANCE * abs(sums[0]):
            break
        last = sums[0]
    return m


def _arrays(batch: pa.RecordBatch, numbers: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([np.asarray(batch.column(i).to_numpy(zero_copy_only=False), float) for i in range(numbers)], 1) if numbers else np.zeros((batch.num_rows, 0))
    c = np.stack([np.asarray(pa.compute.fill_null(batch.column(numbers + i), -1)) for i in range(kinds)], 1).astype(int) if kinds else np.zeros((batch.num_rows, 0), int)
    return x, c


def fit(rows: DataFrame, numbers: list[str], kinds: list[str], codes: list[int], components: int = COMPONENTS) -> Mixture:
    """Fit on all rows; ``numbers`` are centred and scaled columns, ``kinds`` code positions, NULL where missing; ``__o`` orders the rows of the start."""
    cols = [*numbers, *kinds]
    head = rows.orderBy("__o").limit(START_ROWS).select(*cols).toArrow().combine_chunks().to_batches()
    x, c = _arrays(head[0], len(numbers), len(kinds)) if head else (np.zeros((0, len(numbers))), np.zeros((0, len(kinds)), int))
    model, last = start(x, c, codes, components), -math.inf
    while True:
        held = rows.sparkSession.sparkContext.broadcast(model)

        def reduce_(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                s = statistics(held.value, *_arrays(batch, len(numbers), len(kinds)))
                total = s if total is None else total + s
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

        sums = rows.select(*cols).mapInArrow(reduce_, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
        if not len(sums):
            return model
        rounds, gain = model.rounds + 1, float((sums[0] - last) / max(abs(sums[0]), 1e-300))
        model, last = updated(model, sums), sums[0]
        model.rounds, model.gain = rounds, gain
        if not abs(gain) >= TOLERANCE:
            return model


def fill_missing(
    df: DataFrame, id_col: str, group_col: str, numeric: list[Feature], categorical: list[Feature], targets: list[str], decimals: dict[str, int] | None = None, values: dict[str, Column] | None = None, components: int = COMPONENTS
) -> DataFrame:
    """One row a record: all columns of ``df``, targets filled, and ``<target>_filled`` marks.

    A cell is missing when it is null, NaN or outside its feature's domain.
    Filled values lie inside the domain, rounded to ``decimals`` of the field;
    all other cells stay as they are, and a known cell is never changed.
    ``values`` gives the modelled value of a field that needs one (a unit).
    Repeated deliveries of an id count as one record, of which any is kept;
    rows without an id count as one record. A null group is a group of its own; a
    group without any known value of a field uses the overall mean, a field
    without any known value the middle of its domain or its first code. An empty
    table gives an empty table.
    """
    spark, values, decimals = df.sparkSession, values or {}, decimals or {}
    num, cat = [f.name for f in numeric], [f.name for f in categorical]
    named = {f"__x{i}": known(values.get(f.name, F.col(f.name)), f) for i, f in enumerate(numeric)}
    named |= {f"__c{i}": F.expr("CASE " + " ".join(f"WHEN `{f.name}` = {float(c)} THEN {j}" for j, c in enumerate(f.codes)) + " END").cast("int") for i, f in enumerate(categorical)}
    # Columns go under names of our own, whatever they are called.
    own = {c: f"__u{i}" for i, c in enumerate(df.columns)}
    base = df.select(*[F.col(f"`{c}`").alias(u) for c, u in own.items()], F.col(id_col).alias("__id"), F.col(group_col).cast("string").alias("__g"), *[v.alias(k) for k, v in named.items()])
    base = stored(base.dropDuplicates(["__id"]), "records")
    xs = [f"__x{i}" for i in range(len(num))]
    over = base.agg(*[F.avg(x).alias(f"{x}_m") for x in xs], *[F.stddev_pop(x).alias(f"{x}_s") for x in xs]).first()
    mean = [over[f"{x}_m"] if over[f"{x}_m"] is not None else (f.lo + f.hi) / 2 for x, f in zip(xs, numeric)]
    scale = [over[f"{x}_s"] or 1.0 for x in xs]
    rows_in = base.count()
    groups = base.groupBy("__g").agg(*[((F.coalesce(F.sum(x), F.lit(0.0)) + F.lit(GROUP_PRIOR * m)) / (F.count(x) + F.lit(GROUP_PRIOR))).alias(f"{x}_g") for x, m in zip(xs, mean)])
    groups = stored(groups.withColumnRenamed("__g", "__h"), "groups")
    scaled = [((F.col(x) - F.col(f"{x}_g")) / F.lit(s)).alias(f"z{i}") for i, (x, s) in enumerate(zip(xs, scale))]
    zs, cs = [f"z{i}" for i in range(len(xs))], [f"__c{i}" for i in range(len(cat))]
    rows = beside(base.select("__id", "__g", *xs, *cs), groups, "__g", F.col("__id"), rows_in)
    rows = stored(rows.select(F.xxhash64("__id").alias("__o"), "__g", *scaled, *cs), "scaled")
    model = fit(rows, zs, cs, [len(f.codes) for f in categorical], components)
    held = spark.sparkContext.broadcast(model)
    k = len(model.weights)
    rs = [f"r{j}" for j in range(k)]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Responsibilities summed by the groups of a batch."""
        for batch in batches:
            r, _ = responsibilities(log_joint(held.value, *_arrays(batch, len(zs), len(cs)))[0])
            named = batch.column(len(zs) + len(cs)).dictionary_encode(null_encoding="encode")
            at = np.asarray(named.indices)
            total = np.stack([np.bincount(at, r[:, j], len(named.dictionary)) for j in range(k)])
            yield pa.RecordBatch.from_arrays([named.dictionary, *[pa.array(t) for t in total]], ["__g", *rs])

    share = rows.select(*zs, *cs, "__g").mapInArrow(weigh, "__g string, " + ", ".join(f"{r} double" for r in rs)).groupBy("__g")
    share = share.agg(*[(F.sum(r) + F.lit(float(GROUP_PRIOR * w))).alias(f"p{j}") for j, (r, w) in enumerate(zip(rs, model.weights))])
    small = stored(groups.join(share, F.col("__g").eqNullSafe(F.col("__h"))).drop("__g"), "group-weights")
    incomplete = F.lit(False)
    for t in targets:
        incomplete = incomplete | F.col(f"__x{num.index(t)}" if t in num else f"__c{cat.index(t)}").isNull()
    todo = beside(base.where(incomplete), small, "__g", F.col("__id"), rows_in)
    kept = [*own.values(), *xs, *cs]
    fills = [f"__f{i}" for i in range(len(targets))]

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            x, c = _arrays(batch, len(zs), len(cs))
            at = len(zs) + len(cs)
            prior = np.stack([np.asarray(batch.column(at + j)) for j in range(k)], 1)
            centre = np.stack([np.asarray(batch.column(at + k + i)) for i in range(len(zs))], 1) if zs else np.zeros((batch.num_rows, 0))
            at += k + len(zs)
            ll, patterns = log_joint(m, x, c, prior / prior.sum(1, keepdims=True))
            r, _ = responsibilities(ll)
            guess = expected(m, x, r, patterns) * np.array(scale) + centre
            out = [batch.column(at + i) for i in range(len(kept))]
            for t in targets:
                if t in num:
                    f = numeric[num.index(t)]
                    places = decimals.get(t, 6)
                    step = 10.0**-places  # rounded inwards where a bound isn't a multiple of the step
                    v = np.clip(np.round(guess[:, num.index(t)], places), math.ceil(f.lo / step - 1e-9) * step, math.floor(f.hi / step + 1e-9) * step)
                    out.append(pa.array(v))
                else:
                    i = cat.index(t)
                    out.append(pa.array(np.array(categorical[i].codes, float)[(r @ m.tables[i]).argmax(1)]))
            yield pa.RecordBatch.from_arrays(out, [*kept, *fills])

    # Incomplete records alone pass through the model, with all their columns, so nothing is joined by record.
    shape = StructType([*base.select(*kept).schema.fields, *[StructField(f, DoubleType()) for f in fills]])
    done = todo.select(*scaled, *[F.col(c) for c in cs], *[f"p{j}" for j in range(k)], *[f"{x}_g" for x in xs], *kept).mapInArrow(complete, shape)
    joined = base.where(~incomplete).select(*kept, *[F.lit(None).cast("double").alias(f) for f in fills]).unionByName(done)
    out = []
    for c in df.columns:
        if c in targets:
            i = targets.index(c)
            lost = F.col(f"__x{num.index(c)}" if c in num else f"__c{cat.index(c)}").isNull()
            out.append(F.when(lost, F.col(f"__f{i}").cast(dict(df.dtypes)[c])).otherwise(F.col(own[c])).alias(c))
        else:
            out.append(F.col(own[c]).alias(c))
    marks = [F.col(f"__x{num.index(t)}" if t in num else f"__c{cat.index(t)}").isNull().alias(f"{t}_filled") for t in targets]
    return joined.select(*out, *marks)
