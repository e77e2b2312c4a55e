import numpy as np
import pytest
from pyspark.sql import functions as F

from probloom.llm import neighbours as K

ROW = "image_id long, pixel_data array<short>, h int, vec string, d double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 0.0) for i, v in rows], ROW)  # columns with clashing names


def brute(x, ids, q, k):
    d = ((x.astype(int) - x[q].astype(int)) ** 2).sum(1)
    order = [i for i in np.lexsort((ids, d)) if i != q]
    return [int(ids[i]) for i in order[:k]]


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 256, (20, 48))
    x = np.clip(centres[rng.integers(0, 20, 400)] + rng.normal(0, 12, (400, 48)), 0, 255).astype(int)
    x[7] = x[8] = x[9]  # copies
    return x, np.arange(1000, 1400)


def test_exact_equals_brute_force_and_curves_recall(spark, clustered):
    x, ids = clustered
    rows = [(int(i), [int(v) for v in r]) for i, r in zip(ids, x)]
    rows += rows[:5]  # repeated deliveries
    rows += [(1, None), (2, []), (3, [1] * 47), (4, [None] + [1] * 47), (5, [300] * 48), (None, [1] * 48)]
    index = K.build_index(table(spark, rows), "image_id", "pixel_data", 48, 0, 255)
    asked = spark.createDataFrame([(int(i),) for i in ids[::7]] + [(1007,), (1007,), (1,), (99999,)], "id long")
    got = {}
    for r in K.search(index, asked, 10, exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["neighbour_id"])
    assert set(got) == {int(i) for i in ids[::7]} | {1007}
    for q, found in got.items():
        assert found == brute(x, ids, q - 1000, 10)
    near = {}
    for r in K.search(index, asked, 10).collect():
        near.setdefault(r["query_id"], set()).add(r["neighbour_id"])
    assert np.mean([len(near[q] & set(got[q])) / 10 for q in got]) >= 0.9


def test_copies_are_nearest_by_smaller_id(spark):
    rows = [(i, [7] * 16) for i in range(30)] + [(100, [8] * 16)]
    index = K.build_index(table(spark, rows), "image_id", "pixel_data", 16, 0, 255)
    out = K.search(index, spark.createDataFrame([(20,), (3,)], "id long"), 4, exact=True).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["neighbour_id"], r["distance"]) for r in out] == [(3, 0, 0.0), (3, 1, 0.0), (3, 2, 0.0), (3, 4, 0.0), (20, 0, 0.0), (20, 1, 0.0), (20, 2, 0.0), (20, 3, 0.0)]


def test_empty_and_lonely(spark):
    empty = K.build_index(table(spark, []), "image_id", "pixel_data", 16, 0, 255)
    assert K.search(empty, spark.createDataFrame([(1,)], "id long"), 3, exact=True).count() == 0
    one = K.build_index(table(spark, [(1, [5] * 16)]), "image_id", "pixel_data", 16, 0, 255)
    assert K.search(one, spark.createDataFrame([(1,)], "id long"), 3, exact=True).count() == 0


def test_floats(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    index = K.build_index(df, "id", "v", 8, -100, 100)
    x = x.astype(np.float32).astype(float)
    got = {}
    for r in K.search(index, df.select("id").where(F.col("id") < 20), 5, exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["neighbour_id"])
    for q in range(20):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        assert got[q] == list(np.argsort(d)[:5])


def test_hilbert_curve_is_a_walk():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 2, indexing="ij"), -1).reshape(-1, 2)
    keys = K.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(64))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
