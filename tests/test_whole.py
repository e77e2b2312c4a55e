"""Operators and queries that must use every row."""

import numpy as np
from pyspark.sql import functions as F

from probloom.model import learn as L
from probloom.operators import dependence as D
from probloom.plans import models, tables
from probloom.runtime import stored


def test_stability_takes_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 5000
    a = rng.poisson(4, n)
    x = np.stack([a, rng.poisson(1 + a / 10), rng.binomial(2, 0.1, n)], 1).astype(float)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "user_id long, click double, view double, purchase double")
    monkeypatch.setattr(models, "user_counts", lambda s, d: df)
    order = [r[0] for r in df.orderBy(F.xxhash64("user_id"), "user_id").select("user_id").collect()]
    want = D.stability_pvalues(x[order])
    cols = ["click", "view", "purchase"]
    got = {(r["a"], r["b"]): r["p"] for r in models.stability_pvalues(spark, "").collect()}
    assert got == {(p, q): round(float(want[i, j]), 8) for i, p in enumerate(cols) for j, q in enumerate(cols) if i != j}
    few = D.stability_pvalues(x[order[:2000]])
    assert any(abs(few[i, j] - want[i, j]) > 1e-4 for i in range(3) for j in range(3) if i != j)  # 2000 rows give others


def test_stability_of_groups_and_of_few_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.poisson(3, (700, 3)).astype(float)
    x[:300, 1] = 2.0
    df = spark.createDataFrame([(i, int(i >= 300), *map(float, r)) for i, r in enumerate(x)], "id long, g long, a double, b double, c double")
    got = D.stability_over_rows(df, {0: ["a", "b"], 1: ["a", "b", "c"]}, ["id"], dict.fromkeys("abc", "g"))
    assert np.allclose(got[0], D.stability_pvalues(x[:300, :2]))
    assert np.allclose(got[1], D.stability_pvalues(x[300:]))
    assert (D.stability_over_rows(df.limit(15), {0: ["a", "b"]}, ["id"])[0] == 0).all()
    assert (D.stability_over_rows(df.limit(0), {0: ["a", "b"]}, ["id"])[0] == 1).all()


def test_topics_use_every_document(spark, monkeypatch):
    seen = []

    class Watched(tables.LDA):
        def fit(self, dataset, params=None):
            seen.append(self.getMaxIter() * self.getSubsamplingRate() if self.getOptimizer() == "online" else 1)
            assert self.getOptimizer() != "online" or self.getSubsamplingRate() == 1.0
            return super().fit(dataset, params)

    monkeypatch.setattr(tables, "LDA", Watched)
    docs = spark.createDataFrame([(i, f"alpha beta w{i % 7} w{i % 5} w{i % 3}") for i in range(40)], "doc_id long, text string")
    monkeypatch.setattr(tables, "table", lambda s, d, n: docs)
    assert tables.topics(spark, "").count() == 5 and seen == [8.0]


def _level(spark, x, most):
    """A table of the learner with one slice of all rows."""
    d = x.shape[1]
    base = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"x{i} double" for i in range(d)))
    data = stored(L._numbered(base, [f"x{i}" for i in range(d)]), "slices")
    s = L.Slice(0, list(range(d)), rows=float(len(x)))
    rows = L.SparkRows(data, d)
    rows.samples([s])
    assert data.count() == len(x) and len(s.sample) == min(most, len(x))
    return rows, s


def test_samples_take_equal_rows_by_their_share_and_no_more_than_the_bound(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE", 300)
    x = np.stack([np.where(np.arange(6000) % 3 == 0, 7.0, np.arange(6000)), np.where(np.arange(6000) % 3 == 0, 1.0, np.arange(6000) % 11)], 1)
    _, s = _level(spark, x, 300)
    assert 0.22 < (s.sample[:, 0] == 7).mean() < 0.45


def test_column_splits_count_all_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE", 200)
    rng = np.random.default_rng(3)
    n = 4000
    a, e = rng.poisson(4, n), rng.normal(size=n)
    x = np.stack([a, rng.poisson(1 + a / 12), e, e + rng.normal(size=n)], 1).astype(float)
    kinds = ["discrete", "discrete", "continuous", "continuous"]
    level, s = _level(spark, x, 200)
    data, seen = level.data, []
    monkeypatch.setattr(L, "above", lambda m, t: seen.append(m) or [1] * len(m))
    monkeypatch.setattr(L, "significant", lambda m, t: seen.append(m) or [1] * len(m))
    for columns in ("ami", "rdc", "stability", "blockwise"):
        L._column_groups(level, [s], kinds, [np.array([v]) for v in x.min(0)], L.Settings(columns=columns))
    ami, rdc, stable, block = seen
    assert np.abs(ami - D.ami_matrix(x, kinds)).max() < 0.01
    assert np.abs(rdc - D.rdc_matrix(x)).max() < 0.02
    rows = np.array([list(r)[:4] for r in data.orderBy("h").select("x0", "x1", "x2", "x3").collect()])
    p = D.stability_pvalues(rows)
    assert np.allclose(stable, np.minimum(p, p.T)) and np.allclose(block, stable)


def test_modal_split_lies_in_the_valley_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE", 50)
    x = np.concatenate([np.full(3000, 0.0) + np.arange(3000) % 30, np.full(3000, 60.0) + np.arange(3000) % 30, [45.0] * 3])[:, None]
    rows, s = _level(spark, x, 50)
    seen = []
    own = rows.sums
    monkeypatch.setattr(rows, "sums", lambda *a: seen.append(own(*a)) or seen[-1])
    L._valleys(rows, [s], {0: np.random.default_rng(1)})
    assert seen[0][0].sum() == 6003


def test_kernel_leaf_weighs_every_row(spark):
    x = np.concatenate([np.full(2000, 1.0), np.full(1000, 5.0), np.linspace(8, 10, 1000)])
    leaf = L.learn(spark.createDataFrame([(float(v),) for v in x], "a double"), ["a"], ["continuous"], L.Settings(families="kde"))
    assert abs(sum(leaf.shares) - 1) < 1e-9 and abs(leaf.mean() - x.mean()) < 0.03
    at = np.array([1.0, 5.0, 9.0])
    kernel = np.exp(-((at[:, None] - x[None]) ** 2) / (2 * 0.2**2)).mean(1) / (0.2 * np.sqrt(2 * np.pi))
    want = np.log(0.01 / 9 + 0.99 * kernel)
    assert np.abs(leaf.numpy(at) - want).max() < 0.05
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in at], "a double").select(leaf.column(F.col("a"))).collect()]
    assert np.allclose(got, leaf.numpy(at))
