"""The most similar vectors of every vector, by shifted space-filling curves.

Index. Vectors are checked and packed to bytes, equal vectors share one entry
(keyed by a 64-bit hash), and every entry is projected on the leading principal
directions. Several Hilbert curves, each over its own random rotation and shift
of the leading coordinates, order the entries; a curve's keys are cut into
ranges of about ``BUCKET`` entries.

Search. A query looks at the ``window`` entries on both sides of its place on
every curve; the windows are merged, ranked by projected distance and the best
``RERANK`` are compared with the true vectors, which meet in two joins on hashes:
the work grows with the queries, not with queries times rows.

Where ``exact`` is asked for, a check follows: one pass over all rows for every
``BLOCK`` queries, the only data that is ever broadcast. The k-th distance found
on the curves is the radius; a row is compared only if a lower bound of its
distance (projection plus residual norms) is within it, and rows that the curves
missed are added, so the answer equals brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probloom.runtime import salted_rank, stored

#: Entries of a key range, query vectors of a block of the exact check, rows the projection is fitted on.
BUCKET, BLOCK, FIT_ROWS = 8192, 4096, 2048
CURVES, CURVE_DIMS, CURVE_BITS, ROTATED = 8, 10, 5, 24
RANK_DIMS, BOUND_DIMS = 64, 128
#: Best entries of a window, candidates of a query, pairs of a group, bytes of vectors of a task.
PER_WINDOW, RERANK, RERANK_ROWS, TASK_BYTES = 16, 24, 8192, 1 << 27


@dataclass
class VectorIndex:
    """``rows``: (id, h, vec) of all valid rows; ``entries``: (h, proj, keys) of distinct vectors."""

    rows: DataFrame
    entries: DataFrame
    mean: np.ndarray
    basis: np.ndarray
    dim: int
    kind: str
    size: int = 0


def matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    """Rows of a binary Arrow column as a matrix."""
    width = dim * np.dtype(kind).itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    assert len(data) == len(column) * width
    return data.view(kind).reshape(len(column), dim)


def packed(x: np.ndarray) -> pa.Array:
    """A matrix as a binary Arrow column, one value a row."""
    raw = np.ascontiguousarray(x)
    width = raw.shape[1] * raw.itemsize
    offsets = (np.arange(len(raw) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])


def compact_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int, lo: float, hi: float) -> tuple[DataFrame, str]:
    """(id, vec) of the valid rows, vec as packed bytes, and the element kind.

    Valid: a non-null id and exactly ``dim`` non-null elements within
    ``lo..hi``. Null or empty vectors, other lengths, null, NaN or outlying
    elements leave a row out; it is neither query nor neighbour.
    """
    kind = "uint8" if lo >= 0 and hi <= 255 and "double" not in dict(df.dtypes)[vec_col] and "float" not in dict(df.dtypes)[vec_col] else "float32"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, ids = batch.column(1), batch.column(0)
            good = np.asarray(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(vecs), dim), False)) & np.asarray(ids.is_valid())
            picked = vecs.filter(pa.array(good))
            if not len(picked):
                continue
            flat = picked.flatten()
            ids = ids.filter(pa.array(good))
            valid = np.ones(len(picked), bool)
            if flat.null_count:
                valid &= np.asarray(flat.is_valid()).reshape(-1, dim).all(1)
                flat = pa.compute.fill_null(flat, 0)
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
            valid &= (x.min(1) >= lo) & (x.max(1) <= hi)  # NaN fails both
            if valid.any():
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(valid)).cast(pa.int64()), packed(x[valid].astype(kind))], ["id", "vec"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).mapInArrow(pack, "id long, vec binary"), kind


def principal(x: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and ``dims`` orthonormal leading directions (randomised range finder, fixed seed)."""
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    y = (x - mean).astype(np.float32)
    dims = min(dims, x.shape[1])
    seed = np.random.default_rng(7)
    q = np.linalg.qr(y.T @ seed.standard_normal((len(y), min(dims + 16, x.shape[1]))).astype(np.float32) if len(y) else seed.standard_normal((x.shape[1], dims)))[0]
    for _ in range(3 if len(y) else 0):
        q = np.linalg.qr(y.T @ (y @ q))[0]
    b = y @ q
    _, e = np.linalg.eigh(b.T @ b)
    basis = (q @ e[:, ::-1])[:, :dims].astype(np.float32)
    if basis.shape[1] < dims:  # fewer rows than directions
        basis = np.linalg.qr(np.hstack([basis, seed.standard_normal((x.shape[1], dims - basis.shape[1])).astype(np.float32)]))[0]
    return mean.astype(np.float32), np.ascontiguousarray(basis.astype(np.float32))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of integer cells (rows of coordinates below 2**bits) on the Hilbert curve."""
    x = np.ascontiguousarray(cells.T).astype(np.int64)
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations of the finer levels
        low = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn = np.where((x[-1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_frames(sample: np.ndarray, curves: int = CURVES) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rotation, origin and scale of every curve, from the projected fitting rows."""
    seed, wide = np.random.default_rng(11), min(ROTATED, sample.shape[1])
    dims, frames = min(CURVE_DIMS, wide), []
    for _ in range(curves):
        turn = np.linalg.qr(seed.standard_normal((wide, wide)))[0][:, :dims].astype(np.float32)
        z = sample[:, :wide] @ turn if len(sample) else np.zeros((1, dims))
        lo, hi = np.percentile(z, 0.5, axis=0), np.percentile(z, 99.5, axis=0)
        width = np.maximum(hi - lo, 1e-9)
        frames.append((turn, lo - seed.random(dims) * width / 3, (1 << CURVE_BITS) / (1.5 * width)))
    return frames


def build_index(df: DataFrame, id_col: str, vec_col: str, dim: int, lo: float, hi: float) -> VectorIndex:
    """Index every valid row; the projection alone is fitted on ``FIT_ROWS`` rows, those of smallest hash."""
    spark = df.sparkSession
    rows, kind = compact_vectors(df, id_col, vec_col, dim, lo, hi)
    rows = stored(rows.select("id", F.xxhash64("vec").alias("h"), "vec"), "vectors")
    n = rows.count()
    share = min(1.0, 4 * FIT_ROWS / max(n, 1))
    fit = rows.where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).orderBy(F.xxhash64("h")).limit(FIT_ROWS).select("vec").toArrow()["vec"]
    sample = np.vstack([matrix(c, dim, kind) for c in fit.chunks if len(c)]).astype(np.float32) if len(fit) else np.zeros((0, dim), np.float32)
    mean, basis = principal(sample, BOUND_DIMS)
    frames = curve_frames((sample - mean) @ basis)
    model = spark.sparkContext.broadcast((mean, basis[:, :RANK_DIMS], frames))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, basis, frames = model.value
        for batch in batches:
            x = matrix(batch.column(1), dim, kind)
            for at in range(0, len(x), 2048):
                p = (x[at : at + 2048].astype(np.float32) - mean) @ basis
                keys = np.stack([hilbert_keys(np.clip((p[:, : len(turn)] @ turn - origin) * scale, 0, (1 << CURVE_BITS) - 1).astype(np.int64), CURVE_BITS) for turn, origin, scale in frames], 1)
                h = batch.column(0).slice(at, len(p))
                keys = (keys << 13) | (np.asarray(h).astype(np.int64) & 0x1FFF)[:, None]  # splits ties, so that no range is unbounded
                yield pa.RecordBatch.from_arrays([h, packed(p.astype(np.float16)), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))], ["h", "proj", "keys"])

    entries = rows.select("h", "vec").mapInArrow(project, "h long, proj binary, keys array<long>")
    entries = stored(entries.groupBy("h").agg(F.first("proj").alias("proj"), F.first("keys").alias("keys")), "entries")
    return VectorIndex(rows, entries, mean, basis, dim, kind, n)


def curve_candidates(index: VectorIndex, wanted: DataFrame, window: int = 64) -> DataFrame:
    """(q, c): hashes of a query vector, and of itself and its ``RERANK`` best entries in the curve windows."""
    spark = index.rows.sparkSession
    n = index.entries.count()
    ranges = max(1, math.ceil(n / BUCKET))
    cuts = np.zeros((CURVES, 0), np.int64)
    if ranges > 1:
        at = ",".join(f"{i / ranges:.8f}D" for i in range(1, ranges))
        got = index.entries.selectExpr(*[f"percentile_approx(keys[{c}], array({at}), {max(1000, 20 * ranges)}) AS c{c}" for c in range(CURVES)]).first()
        cuts = np.array([got[c] for c in range(CURVES)], np.int64)
    bounds = spark.sparkContext.broadcast(cuts)
    width = min(RANK_DIMS, index.basis.shape[1])
    fields = "curve int, bucket int, key long, h long, proj binary, role int"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Role 0: an entry; 1: an entry that is a query as well; 2: a query visiting the next range."""
        cuts = bounds.value
        for batch in batches:
            keys = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, CURVES)
            asked = np.asarray(batch.column(3))
            for c in range(CURVES):
                bucket = np.searchsorted(cuts[c], keys[:, c], side="right").astype(np.int32)
                for step, role, mask in ((0, asked.astype(np.int32), np.ones(len(asked), bool)), (-1, None, asked & (bucket > 0)), (1, None, asked & (bucket < cuts.shape[1]))):
                    idx = np.nonzero(mask)[0]
                    if len(idx):
                        roles = role[idx] if role is not None else np.full(len(idx), 2, np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), c, np.int32)), pa.array(bucket[idx] + np.int32(step)), pa.array(keys[idx, c]), batch.column(0).take(pa.array(idx)), batch.column(1).take(pa.array(idx)), pa.array(roles)], [x.split()[0] for x in fields.split(", ")])

    def look(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        role, key, h = (np.asarray(group[c]) for c in ("role", "key", "h"))
        proj = np.vstack([matrix(c, width, "float16") for c in group["proj"].chunks]).astype(np.float32)
        own = np.nonzero(role < 2)[0]
        own = own[np.lexsort((h[own], key[own]))]
        asked = np.nonzero(role > 0)[0]
        qs, cs, ds = [], [], []
        for at in range(0, len(asked), 512):
            q = asked[at : at + 512]
            place = np.searchsorted(key[own], key[q])
            idx = place[:, None] + np.arange(-window, window + 1)
            inside = (idx >= 0) & (idx < len(own))
            idx = own[np.clip(idx, 0, max(len(own) - 1, 0))] if len(own) else np.zeros((len(q), 0), int)
            if not idx.size:
                continue
            d = np.where(inside, ((proj[idx] - proj[q][:, None]) ** 2).sum(2), np.inf)
            best = np.argsort(d, axis=1)[:, :PER_WINDOW]
            d = np.take_along_axis(d, best, 1)
            ok = np.isfinite(d)
            qs.append(np.repeat(h[q], ok.sum(1)))
            cs.append(h[np.take_along_axis(idx, best, 1)][ok])
            ds.append(d[ok])
        join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
        return pa.table({"q": join(qs, pa.int64()), "c": join(cs, pa.int64()), "d": join(ds, pa.float64())})

    marked = index.entries.join(wanted.select(F.col("h"), F.lit(True).alias("asked")), "h", "left").select("h", "proj", "keys", F.coalesce("asked", F.lit(False)).alias("asked"))
    pairs = marked.mapInArrow(spread, fields).groupBy("curve", "bucket").applyInArrow(look, "q long, c long, d double")
    best = pairs.where("q <> c").groupBy("q", "c").agg(F.min("d").alias("d"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "c"))
    return best.withColumn("r", rank).where(F.col("r") <= RERANK).select("q", "c").unionByName(wanted.select(F.col("h").alias("q"), F.col("h").alias("c")))


def _closest(d: np.ndarray, ids: np.ndarray, q: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """The ``keep`` smallest (distance, id) of every query among distinct ids."""
    order = np.lexsort((ids, d, q))
    q, ids, d = q[order], ids[order], d[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])  # repeated deliveries lie side by side
    q, ids, d = q[fresh], ids[fresh], d[fresh]
    first = np.searchsorted(q, q, side="left")
    take = np.arange(len(q)) - first < keep
    return q[take], ids[take], d[take]


def _measure(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (x[i], y[j]); whole numbers for bytes."""
    out = np.empty(len(i))
    for at in range(0, len(i), 1024):
        s = slice(at, at + 1024)
        if x.dtype == np.uint8:
            d = x[i[s]].astype(np.int16) - y[j[s]].astype(np.int16)
            out[s] = np.einsum("ij,ij->i", d.astype(np.int32), d.astype(np.int32))
        else:
            d = x[i[s]].astype(np.float64) - y[j[s]]
            out[s] = np.einsum("ij,ij->i", d, d)
    return out


def reranked(index: VectorIndex, pairs: DataFrame, keep: int) -> DataFrame:
    """(q, c, d): the squared distances of the pairs (q, c) of hashes, of each query the ``keep`` smallest and ties.

    Each vector is sent once to its candidates and once a pair to its query;
    copies of a vector are one entry.
    """
    dim, kind = index.dim, index.kind
    pairs = pairs.select("q", "c")
    width, total, least = dim * np.dtype(kind).itemsize, pairs.count(), int(index.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = lambda vectors: max(least, math.ceil(vectors * width / TASK_BYTES))
    parts = max(1, math.ceil(total / RERANK_ROWS))
    # The row of smallest id stands for its copies.
    stands = index.rows.select("h", "id").groupBy("h").agg(F.min("id").alias("id"))
    asked = pairs.join(stands, F.col("c") == F.col("h")).select("q", "c", F.col("id").alias("of")).repartition(tasks(index.size), "of")

    def near(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        q, c = np.asarray(group["q"]), np.asarray(group["c"])
        x = np.vstack([matrix(v, dim, kind) for v in group["vec"].chunks])
        once = np.lexsort((c, q))
        once = once[np.concatenate([[True], (np.diff(q[once]) != 0) | (np.diff(c[once]) != 0)])]  # repeated deliveries of a row
        q, c, x = q[once], c[once], x[once]
        own = np.nonzero(q == c)[0]
        own = own[np.argsort(q[own])]
        d = _measure(x, np.arange(len(q)), x, own[np.searchsorted(q[own], q)])
        order = np.lexsort((d, q))
        q, c, d = q[order], c[order], d[order]
        first = np.searchsorted(q, q, side="left")
        limit = d[np.minimum(first + keep, np.searchsorted(q, q, side="right")) - 1]
        ok = d <= limit
        return pa.table({"q": q[ok], "c": c[ok], "d": d[ok]})

    met = index.rows.join(asked, (F.col("id") == F.col("of")) & (F.col("h") == F.col("c"))).select("q", "c", "vec", F.pmod(F.xxhash64("q"), F.lit(parts)).alias("part"))
    return met.repartition(tasks(total), "part").groupBy("part").applyInArrow(near, "q long, c long, d double")


def exact_check(index: VectorIndex, wanted: DataFrame, found: DataFrame, keep: int) -> DataFrame:
    """(q, id, d) of all rows within the ``keep``-th distance that ``found`` (q, id, d) has of each query, ``BLOCK`` queries at a time."""
    spark, dim, kind, basis, mean = index.rows.sparkSession, index.dim, index.kind, index.basis, index.mean
    numbered = stored(salted_rank(wanted.select("h").distinct(), [], [F.col("h")], "no"), "wanted")
    of = stored(found.join(numbered.withColumnRenamed("h", "q"), "q").groupBy("no").agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("n")), "radius")
    parts = []
    for base in range(0, numbered.count(), BLOCK):
        inside = (F.col("no") >= base) & (F.col("no") < base + BLOCK)
        got = index.rows.join(F.broadcast(numbered.where(inside)), "h").groupBy("no").agg(F.first("vec").alias("vec")).orderBy("no").toArrow()  # at most BLOCK rows
        y = np.vstack([matrix(c, dim, kind) for c in got["vec"].chunks if len(c)])
        radius = np.full(len(y), np.inf)
        for r in of.where(inside & (F.col("n") == keep)).collect():  # at most BLOCK rows
            radius[r["no"] - base] = r["d"]
        c = y.astype(np.float32) - mean
        p = c @ basis
        rest = np.sqrt(np.maximum((c * c).sum(1) - (p * p).sum(1), 0))
        held = spark.sparkContext.broadcast((y, mean, basis, p, rest, radius))

        def sweep(batches: Iterator[pa.RecordBatch], held=held, base=base) -> Iterator[pa.RecordBatch]:
            y, mean, basis, p, rest, radius = held.value
            pn, limit = (p * p).sum(1), radius * (1 + 1e-4) + 64
            for batch in batches:
                x, ids = matrix(batch.column(1), dim, kind), np.asarray(batch.column(0))
                for at in range(0, len(x), 1024):
                    part = x[at : at + 1024]
                    c = part.astype(np.float32) - mean
                    z = c @ basis
                    zn = (z * z).sum(1)
                    left = np.sqrt(np.maximum((c * c).sum(1) - zn, 0))
                    low = zn[:, None] + pn[None] - 2 * (z @ p.T) + (left[:, None] - rest[None]) ** 2
                    i, j = np.nonzero(low <= limit[None])
                    if len(i):
                        d = _measure(part, i, y, j)
                        ok = d <= radius[j]
                        yield _batch(*_closest(d[ok], ids[at : at + 1024][i[ok]], j[ok] + base, keep))

        parts.append(stored(index.rows.select("id", "vec").mapInArrow(sweep, "no long, id long, d double"), "exact"))
    out = parts[0] if parts else spark.createDataFrame([], "no long, id long, d double")
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.join(numbered.withColumnRenamed("h", "q"), "no").select("q", "id", "d")


def search(index: VectorIndex, queries: DataFrame, k: int, exact: bool = False, window: int = 64) -> DataFrame:
    """(query_id, neighbour_id, distance, rank, by_curve): the k nearest other rows of every query id.

    ``queries`` has one column ``id``; ids that aren't valid vectors give no
    row, repeated ids count once. Equal distances rank by smaller id; copies of
    a vector are neighbours at distance 0. Fewer than k other rows give fewer.
    ``by_curve``: the curves found the row; without ``exact`` they find all.
    """
    keep = k + 1  # a query may meet itself
    asked = stored(queries.select(F.col("id").cast("long")).distinct().join(index.rows.select("id", "h").distinct(), "id"), "asked")
    wanted = stored(asked.select("h").distinct(), "wanted")
    pairs = stored(curve_candidates(index, wanted, window), "pairs")
    near = stored(reranked(index, pairs, keep), "near")
    # Of copies the smallest ids are enough.
    some = index.rows.select("id", "h").distinct().withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("r") <= keep)
    found = _merged(near.join(some, F.col("c") == F.col("h")).select("q", "id", "d"), keep).withColumn("by_curve", F.lit(True))
    if exact:
        found = stored(found, "found")
        missed = exact_check(index, wanted, found, keep).join(found.select("q", "id"), ["q", "id"], "left_anti").withColumn("by_curve", F.lit(False))
        found = _merged(found.unionByName(missed), keep)
    out = asked.withColumnRenamed("id", "query_id").join(found, F.col("h") == F.col("q")).where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("id").alias("neighbour_id"), F.sqrt("d").alias("distance"), "rank", "by_curve")


def _batch(q: np.ndarray, ids: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(ids.astype(np.int64)), pa.array(d.astype(np.float64))], ["no", "id", "d"])


def _merged(df: DataFrame, keep: int) -> DataFrame:
    """The best of every query; rows of all tasks, each id once."""
    rest = [c for c in df.columns if c not in ("q", "id")]
    once = df.groupBy("q", "id").agg(*[F.min(c).alias(c) for c in rest])
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
    return once.withColumn("r", rank).where(F.col("r") <= keep).drop("r")
