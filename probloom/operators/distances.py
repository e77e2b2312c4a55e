"""Distances: nearest rows of a stated query set, mixed dissimilarity, medoids, word bags."""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probloom.functions import scalar as S
from probloom.runtime import salted_rank, stored

#: Query rows that are held at once.
BLOCK = 2048


def squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), S.lit(0), lambda s, v: s + v)


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(query, nearest, d2): the closest other row of every query row, ties by smaller id.

    Queries are taken in blocks of ``BLOCK`` rows; a block is compared with each
    batch of rows where it lies, and only each task's best goes on.
    """
    spark = rows.sparkSession
    held = stored(salted_rank(queries.select(F.col(id_col).alias("q"), F.col(vec_col).alias("v")).where("v IS NOT NULL"), [], [F.col("q")], "no"), "queries")
    out = None
    for at in range(0, max(held.count(), 1), BLOCK):
        got = held.where((F.col("no") >= at) & (F.col("no") < at + BLOCK)).orderBy("no").toPandas()  # one block
        ids, y = got["q"].to_numpy(np.int64), np.stack(got["v"].to_numpy()).astype(np.float64) if len(got) else np.zeros((0, 1))
        block = spark.sparkContext.broadcast((ids, y, (y * y).sum(1)))

        def scan(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            ids, y, yn = block.value
            if not len(ids):
                return
            best, pick = np.full(len(ids), np.inf), np.full(len(ids), -1, np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                own = np.asarray(b.column(0)).astype(np.int64)
                x = np.stack(b.column(1).to_pylist()).astype(np.float64)
                d = (x * x).sum(1)[:, None] + yn[None] - 2 * (x @ y.T)
                d[own[:, None] == ids[None]] = np.inf
                order = np.lexsort((own,))
                i = order[d[order].argmin(0)]
                low = ((x[i] - y) ** 2).sum(1)
                low = np.where(np.isinf(d[i, np.arange(len(ids))]), np.inf, low)
                better = (low < best) | ((low == best) & (own[i] < pick))
                best, pick = np.where(better, low, best), np.where(better, own[i], pick)
            ok = pick >= 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(pick[ok]), pa.array(best[ok])], ["query", "nearest", "d2"])

        part = rows.select(F.col(id_col).cast("long"), F.col(vec_col)).where(F.col(vec_col).isNotNull()).mapInArrow(scan, "query long, nearest long, d2 double")
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d2", "nearest"))
    return out.withColumn("r", rank).where("r = 1").drop("r")


def gower(a: Sequence[Column], b: Sequence[Column], kinds: Sequence[str], ranges: Sequence[float]) -> Column:
    """Mean dissimilarity of two records over the columns both have: scaled difference of numbers, inequality of categories."""
    parts = [F.when(x.isNotNull() & y.isNotNull(), (x != y).cast("double") if k == "categorical" else F.abs(x - y) / S.lit(r or 1.0)) for x, y, k, r in zip(a, b, kinds, ranges)]
    seen = S.add([p.isNotNull().cast("int") for p in parts])
    return F.when(seen > 0, S.add([F.coalesce(p, S.lit(0)) for p in parts]) / seen)


def gower_matrix(x: np.ndarray, y: np.ndarray, kinds: Sequence[str], ranges: np.ndarray) -> np.ndarray:
    """Dissimilarities of the rows of two small matrices (NaN is missing)."""
    total, seen = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)))
    for j, k in enumerate(kinds):
        d = (x[:, j, None] != y[None, :, j]).astype(float) if k == "categorical" else np.abs(x[:, j, None] - y[None, :, j]) / (ranges[j] or 1)
        ok = ~(np.isnan(x[:, j])[:, None] | np.isnan(y[:, j])[None])
        total += np.where(ok, d, 0)
        seen += ok
    return total / np.maximum(seen, 1)


def medoids(d: np.ndarray, k: int, rounds: int = 20) -> list[int]:
    """k medoids of a small dissimilarity matrix: greedy start, then the best member of each cluster until nothing changes."""
    n = len(d)
    chosen = [int(d.sum(0).argmin())]
    while len(chosen) < min(k, n):
        gain = np.maximum(d[:, chosen].min(1)[:, None] - d, 0).sum(0)
        gain[chosen] = -1
        chosen.append(int(gain.argmax()))
    for _ in range(rounds):
        near = d[:, chosen].argmin(1)
        new = [int(np.nonzero(near == c)[0][d[np.ix_(near == c, near == c)].sum(0).argmin()]) for c in range(len(chosen))]
        if new == chosen:
            break
        chosen = new
    return chosen


def relaxed_transport(bags: DataFrame, key: str, word: str, weight: str, vectors: dict[str, Sequence[float]], reference: dict[str, float]) -> DataFrame:
    """(key, d): relaxed word mover's distance of every bag to a reference bag.

    The greater of both one-sided bounds, where each word moves to its nearest
    word of the other bag. ``bags`` is long (a row per word); words without a
    vector are left out, and a bag without words is infinitely far.
    """
    spark = bags.sparkSession
    vec = spark.createDataFrame([(w, [float(x) for x in v]) for w, v in vectors.items()], "__w string, v array<double>")
    ref = [(w, float(p) / sum(reference.values())) for w, p in reference.items()]
    rv = {w: F.array(*[S.lit(x) for x in vectors[w]]) for w, _ in ref}
    sized = bags.join(vec, F.col(word) == F.col("__w"))  # the vocabulary given may be large
    cost = [F.sqrt(squared(F.col("v"), rv[w])) for w, _ in ref]
    there = sized.withColumn("near", F.least(*cost) if len(cost) > 1 else cost[0])
    agg = there.groupBy(key).agg((F.sum(F.col(weight) * F.col("near")) / F.sum(weight)).alias("go"), *[F.min(c).alias(f"b{i}") for i, c in enumerate(cost)])
    back = S.add([S.lit(p) * F.col(f"b{i}") for i, (_, p) in enumerate(ref)])
    found = agg.select(F.col(key).alias("__k"), F.greatest("go", back).alias("d"))
    return bags.select(key).distinct().join(found, F.col(key) == F.col("__k"), "left").select(key, F.coalesce("d", F.lit(float("inf"))).alias("d"))


def transport(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> float:
    """Exact earth mover's distance of two small bags, by successive shortest paths.

    ``a`` and ``b`` are weights with equal sums, ``cost`` the ground distances.
    """
    n, m = len(a), len(b)
    left, need = np.array(a, float), np.array(b, float)
    flow, total = np.zeros((n, m)), 0.0
    while left.max() > 1e-12 and need.max() > 1e-12:
        dist = np.where(left > 1e-12, 0.0, np.inf)
        to, via_b, via_a = np.full(m, np.inf), np.full(m, -1), np.full(n, -1)
        for _ in range(n + m):
            step = dist[:, None] + cost
            new_to = step.min(0)
            better = new_to < to - 1e-12
            via_b[better] = step.argmin(0)[better]
            to = np.where(better, new_to, to)
            back = np.where(flow > 1e-12, to[None] - cost, np.inf)
            new = back.min(1)
            lower = new < dist - 1e-12
            if not better.any() and not lower.any():
                break
            via_a[lower] = back.argmin(1)[lower]
            dist = np.where(lower, new, dist)
        j = int(np.where(need > 1e-12, to, np.inf).argmin())
        path, end, amount = [], j, need[j]
        while True:
            i = int(via_b[j])
            path.append((i, j, 1))
            if via_a[i] < 0:
                amount = min(amount, left[i])
                break
            path.append((i, int(via_a[i]), -1))
            amount = min(amount, flow[i, via_a[i]])
            j = int(via_a[i])
        for i, k, sign in path:
            flow[i, k] += sign * amount
            total += sign * amount * cost[i, k]
        left[path[-1][0]] -= amount
        need[end] -= amount
    return total


def word_movers(pairs: DataFrame, a: str, b: str, out: str = "emd") -> DataFrame:
    """Append the exact word mover's distance of two bags per row; a bag is an array of structs (weight, vector).

    Weights are scaled to 1 on either side; an empty or null bag gives NULL.
    """

    @F.pandas_udf("double")
    def emd(x: pd.Series, y: pd.Series) -> pd.Series:
        done = []
        for p, q in zip(x, y):
            if p is None or q is None or not len(p) or not len(q):
                done.append(None)
                continue
            u, v = np.array([t["weight"] for t in p]), np.array([t["weight"] for t in q])
            c = np.sqrt(((np.array([t["vector"] for t in p])[:, None] - np.array([t["vector"] for t in q])[None]) ** 2).sum(2))
            done.append(transport(u / u.sum(), v / v.sum(), c))
        return pd.Series(done, dtype="float64")

    return pairs.withColumn(out, emd(a, b))
