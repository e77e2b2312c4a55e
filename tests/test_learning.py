import numpy as np
import pytest
from pyspark.sql import functions as F

from probloom.model import learn as L
from probloom.model import nodes, score
from probloom.model.nodes import Product, Sum
from probloom.model.networks import DependencyNetwork
from probloom.operators import dependence as D


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(1)
    c = rng.integers(0, 2, 1200)
    x = np.stack([np.where(c, 100, 200) + rng.normal(0, 10, 1200), c, rng.poisson(4, 1200), rng.normal(0, 1, 1200)], 1)
    return spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0, 1.0, 1.0), (float("nan"), 1.0, 1.0, 1.0)], "a double, b double, c double, d double")


COLS, KINDS = ["a", "b", "c", "d"], ["continuous", "categorical", "discrete", "continuous"]


def test_structure_is_valid_and_finds_the_dependence(spark, mixed):
    model = L.learn(mixed, COLS, KINDS, L.Settings(min_rows=200, cluster_first=False))
    nodes.validate(model)
    assert isinstance(model, Product) and model.scope == {0, 1, 2, 3}
    assert {2} in [set(c.scope) for c in model.children] and {3} in [set(c.scope) for c in model.children]
    assert any(c.scope == {0, 1} and isinstance(c, Sum) for c in model.children)
    naive = L.learn(mixed, COLS, KINDS, L.Settings(min_rows=10**9))
    mean = lambda m: score.log_likelihood(mixed.dropna().where("NOT isnan(a)"), m, COLS).agg(F.avg("ll")).first()[0]
    assert mean(model) > mean(naive) + 0.4


@pytest.mark.parametrize("rows", ["kmeans", "rdc_kmeans", "random", "hyperplane", "conditioning", "modal", "gower", "dbscan", "poisson"])
def test_row_splits(spark, mixed, rows):
    model = L.learn(mixed, COLS, KINDS, L.Settings(rows=rows, min_rows=700, families=("gaussian", "bernoulli", "poisson", "piecewise")))
    if not isinstance(model, (Sum, Product)):
        raise AssertionError
    nodes.validate(model)
    assert score.log_likelihood(mixed, model, COLS).where("ll IS NULL").count() == 0


@pytest.mark.parametrize("columns", ["rdc", "distance", "ami", "stability", "blockwise", "none"])
def test_column_splits(spark, mixed, columns):
    nodes.validate(L.learn(mixed, COLS, KINDS, L.Settings(columns=columns, min_rows=500)))


@pytest.mark.parametrize("family", ["baseline", "isotonic", "kde", "categorical"])
def test_families(spark, mixed, family):
    families = (family, "categorical", "categorical" if family == "categorical" else family, family) if family != "categorical" else ("histogram", "categorical", "categorical", "histogram")
    model = L.learn(mixed, COLS, KINDS, L.Settings(families=families, min_rows=600, cluster_univariate=True))
    nodes.validate(model)


def test_edges(spark, mixed):
    with pytest.raises(ValueError):
        L.learn(mixed.where("a > 1e9"), COLS, KINDS)
    with pytest.raises(ValueError):
        L.learn(mixed.withColumn("c", F.col("a") * 1e6), COLS, KINDS)
    one = L.learn(mixed, ["a"], ["continuous"])
    assert one.scope == {0}
    flat = spark.createDataFrame([(1.0, 2.0, float(i)) for i in range(400)], "a double, b double, c double")
    model = L.learn(flat, ["a", "b", "c"], ["continuous"] * 3, L.Settings(min_rows=50))
    assert isinstance(model, Product) and model.scope == {0, 1, 2}
    same = spark.createDataFrame([(1.0, 2.0)] * 300, "a double, b double")
    assert L.learn(same, ["a", "b"], ["continuous"] * 2, L.Settings(min_rows=50)).scope == {0, 1}


def test_dependence_measures(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=1500)
    y = np.stack([x, x**2 + rng.normal(0, 0.05, 1500), rng.normal(size=1500), rng.normal(size=1500)], 1)
    m = D.rdc_matrix(y)
    assert m[0, 1] > 0.9 and m[0, 2] < 0.3 and m[2, 3] < 0.3
    df = spark.createDataFrame([tuple(map(float, r)) for r in y], "a double, b double, c double, d double")
    assert np.abs(D.rdc(df, ["a", "b", "c", "d"]) - m).max() < 0.1
    d = D.distance_matrix(y[:500])
    assert d[0, 1] > 0.3 > d[0, 2]
    counts = rng.poisson(np.where(np.arange(800)[:, None] < 400, [[2, 5]], [[9, 5]]))
    p = D.stability_pvalues(np.column_stack([counts[:, 0], np.arange(800), counts[:, 1]]).astype(float))
    assert p[0, 1] < 1e-6 and p[2, 1] > 0.01
    a = D.ami_matrix(np.column_stack([np.arange(300) % 3, np.arange(300) % 3, rng.integers(0, 3, 300)]).astype(float), ["categorical"] * 3)
    assert a[0, 1] == pytest.approx(1) and abs(a[0, 2]) < 0.05


def test_dependency_network(spark):
    rng = np.random.default_rng(2)
    a = rng.poisson(3, 500)
    b = rng.poisson(1 + a)
    df = spark.createDataFrame([(int(u), int(v)) for u, v in zip(a, b)], "a int, b int")
    for kind in ("glm", "tree", "boosted"):
        net = DependencyNetwork(["a", "b"], kind, 3, 3).fit(df)
        assert net.log_likelihood(df).where("ll IS NULL").count() == 0 and net.perplexity(df).first()[0] > 1 and net.size() > 0
    holes = df.limit(5).unionByName(spark.createDataFrame([(None, 9), (2, None)], "a int, b int"))
    done = DependencyNetwork(["a", "b"], "tree", 3).fit(df).complete(holes)
    assert done.where("a IS NULL OR b IS NULL").count() == 0


@pytest.mark.parametrize(("rows", "columns"), [("kmeans", "rdc"), ("rdc_kmeans", "ami"), ("hyperplane", "stability"), ("modal", "none")])
def test_large_slices_are_learned_as_small_ones(spark, mixed, monkeypatch, rows, columns):
    found = {}
    for cells in (0, 1200, 10**6):  # all by passes over the table, a part in tasks, all in one task
        monkeypatch.setattr(L, "LOCAL_CELLS", cells)
        model = L.learn(mixed, COLS, KINDS, L.Settings(rows=rows, columns=columns, min_rows=300))
        nodes.validate(model)
        found[cells] = score.log_likelihood(mixed.dropna().where("NOT isnan(a)"), model, COLS).agg(F.avg("ll")).first()[0]
    assert max(found.values()) - min(found.values()) < 0.6


def test_independent_columns_stay_below_the_threshold():
    rng = np.random.default_rng(8)
    above = [D.rdc_matrix(rng.normal(size=(200, 2)))[0, 1] > 0.3 for _ in range(100)]
    assert np.mean(above) <= 0.05
    c = rng.integers(0, 4, 500)
    m = D.rdc_matrix(np.column_stack([np.where(c == 2, 5.0, 0.0) + rng.normal(0, 1, 500), c, rng.integers(0, 3, 500)]), {1: range(4), 2: range(3)})
    assert m[0, 1] > 0.6 and m[0, 2] < 0.3 and m[1, 2] < 0.3


def test_exact_coefficients_over_all_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 30, 900).astype(float)
    y = np.column_stack([x, (x - 15) ** 2 + rng.normal(0, 20, 900), rng.normal(size=900)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in y] + [(None, 1.0, 2.0)], "a double, b double, c double")
    assert np.abs(D.rdc_exact(df, ["a", "b", "c"]) - D.rdc_matrix(y)).max() < 1e-4


def test_own_strategies_and_nonlinearity(spark, mixed, monkeypatch):
    monkeypatch.setitem(L.ROW_SPLITS, "first_column", lambda s, kinds, rng: lambda x, h, f=s.features[0], m=float(np.median(s.sample[:, s.features[0]])): (x[:, f] > m).astype(int))
    monkeypatch.setitem(L.COLUMN_SPLITS, "correlation", lambda x, kinds: np.abs(np.nan_to_num(np.corrcoef(x.T))))
    for cells in (0, 10**6):
        monkeypatch.setattr(L, "LOCAL_CELLS", cells)
        model = L.learn(mixed, COLS, KINDS, L.Settings(rows="first_column", columns="correlation", min_rows=300, families="normal"))
        nodes.validate(model)
        assert isinstance(model, (Sum, Product))
    nodes.validate(L.learn(mixed, COLS, KINDS, L.Settings(shape=np.tanh, min_rows=500)))
    for bad in (L.Settings(rows="odd", min_rows=300, cluster_first=True), L.Settings(columns="odd", min_rows=300, cluster_first=False)):
        with pytest.raises(Exception):
            L.learn(mixed, COLS, KINDS, bad)


def test_informative_features():
    from probloom.model.leaves import Piecewise
    from probloom.model.measures import informative_features

    leaf = lambda f, top: Piecewise(f, (0.0, float(top), float(top) + 1), (0.1, 0.9, 0.1))
    model = Sum((0.5, 0.5), (Product(tuple(leaf(i, 2) for i in range(5))), Product(tuple(leaf(i, 2 if i < 2 else 0.5) for i in range(5)))))
    assert informative_features(model, list("abcde")) == [(0, list("abcde"))] and len(informative_features(model, list("abcde"), together=2)) == 2
