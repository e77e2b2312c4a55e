import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from probloom.functions import scalar as S
from probloom.operators import distances, folds, graphs, metrics, ordered, rowsplits
from probloom.operators import histograms as H
from probloom.operators import transforms as P
from probloom.runtime import salted_rank


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_scalar_functions(spark):
    x = [0.5, 1.0, 3.0, 10.0, 170.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = [r[0] for r in df.select(S.lgamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(v) for v in x], rel=1e-11, abs=1e-11)
    assert one(spark, S.log_sum_exp(F.array(F.lit(-1000.0), F.lit(-1001.0), F.lit(None).cast("double"))))[0] == pytest.approx(-1000 + math.log(1 + math.exp(-1)))
    assert one(spark, S.log_sum_exp(F.array().cast("array<double>")))[0] is None
    assert one(spark, S.log_add_exp(F.lit(1.0), F.lit(2.0)))[0] == pytest.approx(math.log(math.e + math.e**2))
    assert one(spark, S.gaussian(F.lit(1e6), 0.0, 1.0))[0] == 1e-15
    assert one(spark, S.log_bernoulli(F.lit(1), 0.0), S.bernoulli(F.lit(7), 0.3)) == (-1e3, 0.7)
    with pytest.raises(Exception):
        one(spark, S.bernoulli_strict(F.lit(7), 0.3))
    chi = df.select(S.chi2_sf(F.col("x"), F.lit(3.0)), S.log_chi2_sf(F.col("x"), F.lit(2.0))).collect()
    assert chi[0][0] == pytest.approx(math.erfc(math.sqrt(0.25)) + math.sqrt(1 / math.pi) * math.exp(-0.25), abs=1e-12) and chi[3][1] == pytest.approx(-5)
    inside = one(spark, S.interpolate(F.lit(1.5), [1, 2], [0, 4]), S.interpolate(F.lit(9.0), [1, 2], [0, 4]), S.bin_index(F.lit(2.0), [0, 1, 2]), S.bin_index(F.lit(1.0), [0, 1, 2]), S.bin_index(F.lit(3.0), [0, 1, 2]))
    assert inside == (2.0, 4.0, 1, 1, None)
    x, y = S.to_cartesian([F.lit(0.2), F.lit(0.3), F.lit(0.5)])
    assert one(spark, *S.to_barycentric(x, y)) == pytest.approx((0.2, 0.3, 0.5))
    assert one(spark, S.parse_pairs(F.lit("[a=1, b=2]")))[0] == {"a": "1", "b": "2"}
    assert one(spark, S.words(F.lit("The cat, the DOG!"), ["the"]))[0] == ["cat", "dog"]
    assert one(spark, S.as_json(a=1, b="x"))[0] == '{"a":1,"b":"x"}'


def test_histograms(spark):
    df = spark.createDataFrame([(v, g) for v, g in zip([0.0, 0.5, 1.0, 2.0, 5.0, None], "aabbaa")], "x double, g string")
    n = {r["bin"]: r["n"] for r in H.histogram(df, "x", [0, 1, 2]).collect()}
    assert n == {0: 2, 1: 2}
    by = {(r["g"], r["bin"]): r["n"] for r in H.histogram(df, "x", [0, 1, 2], ["g"]).collect()}
    assert by == {("a", 0): 2, ("a", 1): 0, ("b", 0): 0, ("b", 1): 2}
    f = H.frequencies(H.with_density(H.histogram(df, "x", [0, 1, 2])), 1.0).agg(F.sum("freq"), F.sum("density")).first()
    assert f[0] == pytest.approx(1) and f[1] == pytest.approx(1)
    assert H.domain_edges(1, 3, 1, True) == [0.5, 1.5, 2.5, 3.5] and H.domain_edges(1, 3) == [1, 2, 3, 4]
    for kind in ("continuous", "discrete"):
        xs, ys = H.to_piecewise([0, 1, 2, 4], [0.2, 0.5, 0.1], kind)
        assert np.trapezoid(ys, xs) == pytest.approx(1)
    rng = np.random.default_rng(0)
    counts, edges = np.histogram(np.concatenate([rng.normal(0, 1, 5000), rng.normal(12, 0.3, 5000)]), 128)
    e, dens = H.irregular(counts.astype(float), edges)
    assert 4 < len(dens) < 60 and (dens * np.diff(e)).sum() == pytest.approx(1)
    assert len(H.irregular(np.full(64, 100.0), np.linspace(0, 1, 65))[1]) == 1
    assert 4 < len(H.bayesian_blocks(counts.astype(float), edges)) < 100
    u = H.unimodal([1, 3, 2, 5, 4, 1, 2])
    peak = int(np.argmax(u))
    assert (np.diff(u[: peak + 1]) >= -1e-9).all() and (np.diff(u[peak:]) <= 1e-9).all()
    w = H.resampled(spark.range(3000), 4).groupBy("resample").agg(F.sum("weight").alias("n")).collect()
    assert len(w) == 4 and all(abs(r["n"] - 3000) < 250 for r in w)


def test_order_without_one_big_sort(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 7919 % 101).cast("double").alias("x"))
    pdf = df.toPandas()
    got = {r["id"]: r["ecdf"] for r in ordered.ecdf(df, "x").collect()}
    want = pdf["x"].rank(method="max") / len(pdf)
    assert all(got[i] == pytest.approx(v) for i, v in zip(pdf["id"], want))
    run = {r["id"]: r["s"] for r in ordered.running_sum(df, ["x", "id"], "x", "s").collect()}
    o = pdf.sort_values(["x", "id"])
    assert all(run[i] == v for i, v in zip(o["id"], o["x"].cumsum()))
    mini = spark.createDataFrame([(1, i, v) for i, v in enumerate([3, 1, 2, 0, 5])], "g int, t int, v int")
    assert {r["t"] for r in ordered.local_minima(mini, ["t"], "v", ["g"]).collect()} == {1, 3}
    assert ordered.trapezoid(mini, "t", "v", ["g"]).first()["area"] == pytest.approx(7.0)
    assert ordered.pairs_in_order(mini, ["t"], ["v"], ["g"]).count() == 4
    ranked = salted_rank(df.select((F.col("id") % 3).alias("g"), "id"), ["g"], [F.col("id")], "r", 8).toPandas()
    for _, g in ranked.groupby("g"):
        assert sorted(g["r"]) == list(range(len(g)))


def test_transforms(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], "s string, v double")
    assert [r[0] for r in df.select(P.one_hot("s", ["a", "b"])).collect()] == [[1.0, 0.0], [0.0, 1.0], None]
    with pytest.raises(Exception):
        df.select(P.one_hot("s", ["a"])).collect()
    out = spark.createDataFrame([(float(v),) for v in [*range(100), 10_000]], "v double")
    assert P.without_outliers(out, ["v"], 5).count() == 100 and P.without_outliers(out.where("v < 0"), ["v"]).count() == 0
    z = [r[0] for r in P.standardised(df, ["v"]).select("v").collect()]
    assert np.mean(z) == pytest.approx(0) and np.std(z) == pytest.approx(1)
    px = F.array(*[F.lit(float(i)) for i in range(16)])
    assert one(spark, P.half_mask(px, 4, "left"))[0] == [0, 1, 4, 5, 8, 9, 12, 13] and one(spark, P.half_mask(px, 4, "down"))[0] == list(range(8, 16))
    assert one(spark, P.gray(F.array(F.lit(10.0), F.lit(20.0), F.lit(30.0))))[0] == [pytest.approx(10 * 0.2989 + 20 * 0.587 + 30 * 0.114)]


def test_graphs(spark):
    assert graphs.components(5, [(0, 1), (3, 4)]) == [1, 1, 2, 3, 3]
    assert graphs.above(np.array([[1, 0.4, 0], [0, 1, 0], [0, np.nan, 1]]), 0.3) == [1, 1, 2]
    assert graphs.significant(np.array([[1, 0.001, 1], [0.5, 1, 0.001], [1, 0.0001, 1]]), 0.01) == [1, 2, 2]
    assert graphs.two_bins({1: 5, 2: 4, 3: 3}) == {1: 0, 2: 1, 3: 1}
    assert sorted(set(graphs.two_way_cut(np.kron(np.eye(2), np.ones((3, 3)))))) == [0, 1]
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in graphs.connected(path).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[100] == got[101] == 100
    assert graphs.connected(path.where("a < 0")).count() == 0


def test_distances(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "id long, v array<double>")
    for r in distances.nearest(df.where("id < 20"), df, "id", "v").collect():
        d = ((x - x[r["query"]]) ** 2).sum(1)
        d[r["query"]] = np.inf
        assert r["nearest"] == d.argmin() and r["d2"] == pytest.approx(d.min())
    m = distances.gower_matrix(np.array([[0, 1.0], [10, 2.0]]), np.array([[5, 1.0]]), ["continuous", "categorical"], np.array([10, 1]))
    assert m.ravel() == pytest.approx([0.25, 0.75])
    two = np.array([0, 0.1, 0.2, 9, 9.1, 9.2])
    assert sorted(distances.medoids(np.abs(two[:, None] - two[None]), 2)) == [1, 4]
    assert distances.transport(np.array([0.5, 0.5]), np.array([1.0]), np.array([[1.0], [3.0]])) == pytest.approx(2)
    a, b = rng.random(4), rng.random(5)
    c = np.abs(np.sort(rng.random(4))[:, None] - np.sort(rng.random(5))[None])
    lp = distances.transport(a / a.sum(), b / b.sum(), c)
    assert lp <= ((a / a.sum())[:, None] * (b / b.sum())[None] * c).sum() + 1e-12
    bags = spark.createDataFrame([(1, "x", 1), (1, "y", 1), (2, "none", 3)], "k int, w string, n int")
    got = {r["k"]: r["d"] for r in distances.relaxed_transport(bags, "k", "w", "n", {"x": [0.0], "y": [2.0], "z": [1.0]}, {"z": 1.0}).collect()}
    assert got == {1: 1.0, 2: float("inf")}
    row = spark.sql("SELECT array(named_struct('weight', 1D, 'vector', array(0D)), named_struct('weight', 1D, 'vector', array(2D))) AS a, array(named_struct('weight', 3D, 'vector', array(1D))) AS b, CAST(NULL AS ARRAY<STRUCT<weight: DOUBLE, vector: ARRAY<DOUBLE>>>) AS c")
    assert distances.word_movers(distances.word_movers(row, "a", "b"), "a", "c", "none").select("emd", "none").first() == (1.0, None)


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 1)], "t int, p int")
    r = metrics.classification(df, "t", "p").first()
    assert r["accuracy"] == 0.5 and r["micro_f1"] == 0.5 and r["macro_f1"] == pytest.approx((0.5 + 2 / 3 + 0) / 3)
    ap = spark.createDataFrame([(True, 0.9), (False, 0.8), (True, 0.7)], "y boolean, s double")
    assert metrics.average_precision(ap, "y", "s").first()[0] == pytest.approx((1 + 2 / 3) / 2)
    assert metrics.adjusted_mutual_information(np.diag([10.0, 20.0])) == pytest.approx(1)
    assert metrics.mutual_information(df, "t", "p").first()["mi"] >= 0
    assert metrics.best_run(spark.createDataFrame([(1, 0.5, 9.0), (1, 0.7, 3.0)], "g int, v double, t double"), "v", "t", ["g"]).first()["test_of_best"] == 3.0


def test_folds(spark):
    df = spark.range(23).withColumn("y", F.col("id") % 2)
    f = folds.k_fold(df, ["id"], 5).groupBy("fold").count().orderBy("fold").toPandas()["count"].tolist()
    assert f == [5, 5, 5, 4, 4]
    h = folds.stratified_hold_out(df, "y", [F.col("id")], 0.5).groupBy("y").agg(F.count_if("is_test").alias("n")).orderBy("y").toPandas()["n"].tolist()
    assert h == [6, 5]
    assert folds.stratified_fold(df, "y", [F.col("id")], 3).groupBy("fold").count().count() == 3
    assert folds.balanced_halves(df, [F.col("id")]).where("cluster = 0").count() == 11
    g = folds.generated(spark, 500, list(folds.FAMILIES), 2).toPandas()
    assert len(g) == 500 and not g.isna().any().any() and g["cluster"].nunique() == 2
    for s in ("two_spirals", "cluster_in_cluster", "moons", "half_kernel", "corners", "outlier"):
        assert folds.toy_shape(spark, s, 40).count() == 40
    assert folds.three_node_sample(np.random.default_rng(0), ["continuous", "discrete", "categorical"], [1, 0, 0], 50).shape == (50, 3)


def test_density_clusters_equal_brute_force(spark):
    from probloom.model.learn import dbscan

    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 0.2, (60, 2)), rng.normal(3, 0.3, (60, 2)), rng.uniform(-3, 6, (40, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(999, None, 1.0)], "id long, x double, y double")
    got = {r["id"]: r["cluster"] for r in rowsplits.dbscan(df, "id", ["x", "y"], 0.3, 6).collect()}
    assert 999 not in got and len(got) == len(x)
    want = dbscan(x, 0.3, 6)
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.09
    core = near.sum(1) >= 6
    pairs = {(got[i], want[i]) for i in np.nonzero(core)[0]}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert all((got[i] == -1) == (want[i] == -1) for i in range(len(x)))


def test_splits_keep_all_rows(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=200), "y": rng.normal(size=200)}))
    assert rowsplits.kmeans(df, ["x", "y"]).where("cluster IS NOT NULL").count() == 200
    assert rowsplits.rdc_kmeans(df, ["x", "y"]).count() == 200
    assert rowsplits.hyperplane(df, ["x", "y"], [1.0, 0.0]).count() == 200


def test_exact_quantiles_with_hot_values(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([np.full(3000, 4.0), rng.normal(4, 3, 6000), [1e9]])
    df = spark.createDataFrame(pd.DataFrame({"x": x})).unionByName(spark.createDataFrame([(None,)], "x double"))
    at = [0.0, 0.013, 0.25, 0.5, 0.77, 0.999, 1.0]
    assert np.allclose(P.exact_quantiles(df, "x", at), np.quantile(x, at), rtol=1e-12)
    assert P.discretised(df.where("x > 1e10"), "x", "b").count() == 0 and P.without_outliers(df.where("x > 1e10"), ["x"]).count() == 0


def test_bins_and_pieces_by_halving(spark):
    from probloom.functions import scalar as S

    x = np.concatenate([np.linspace(-2, 12, 300), [0.0, 0.1, 0.3, 10.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for edges in ([i * 0.1 for i in range(101)], [0.0, 0.5, 0.7, 5.0, 10.0], [0.0, 10.0]):
        want = [None if v < edges[0] or v > edges[-1] else min(int(np.searchsorted(edges, v, side="right")) - 1, len(edges) - 2) for v in x]
        assert [r[0] for r in df.select(S.bin_index(F.col("x"), edges)).collect()] == want
    xs, ys = [0.0, 1.0, 1.5, 4.0, 9.0], [1.0, 3.0, 0.0, 2.0, 5.0]
    assert np.allclose([r[0] for r in df.select(S.interpolate(F.col("x"), xs, ys)).collect()], np.interp(x, xs, ys))


def test_distance_correlation_equals_all_pairs():
    from probloom.operators.dependence import distance_correlation

    def centred(v):
        d = np.abs(v[:, None] - v[None])
        return d - d.mean(0)[None] - d.mean(1)[:, None] + d.mean()

    rng = np.random.default_rng(8)
    for n in (2, 3, 50, 333):
        x = rng.integers(0, 9, n).astype(float)
        y = x * 2 + rng.normal(0, 3, n)
        a, b = centred(x), centred(y)
        want = np.sqrt(max((a * b).mean(), 0) / np.sqrt((a * a).mean() * (b * b).mean())) if a.any() and b.any() else 0.0
        assert abs(distance_correlation(x, y) - want) < 1e-9


def test_shares_of_hot_values_by_group(spark):
    rows = [(i % 3, float(v)) for i, v in enumerate([5.0] * 400 + list(range(200)))] + [(None, 1.0), (None, 2.0), (1, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {(r["g"], r["x"]): r["ecdf"] for r in ordered.ecdf(df, "x", by=["g"]).collect()}
    for (g, x), v in got.items():
        own = [b for a, b in rows if a == g and b is not None]
        assert abs(v - sum(b <= x for b in own) / len(own)) < 1e-12


def test_small_helpers(spark):
    from probloom import runtime

    t = runtime.Timer()
    with t.measure("a"):
        pass
    assert t.elapsed["a"] >= 0
    assert H.same_binning([0.0, 1.0], [0.0, 1.0 + 1e-12]) and not H.same_binning("auto", 3) and H.same_binning("auto", "auto")
    assert set(P.random_rules(3, range(10))) == {"rule_0", "rule_1", "rule_2"}
    held = runtime.stored(spark.range(5), "held")
    assert held.count() == 5
    runtime.freed(held)
    with pytest.raises(Exception):
        spark.read.parquet(held._probloom_at).count()
