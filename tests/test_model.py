import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from probloom.model import layers, measures, nodes, score, train
from probloom.model.leaves import KINDS, Bernoulli, BetaLeaf, Categorical, GammaLeaf, Gaussian, Histogram, Isotonic, KernelDensity, Piecewise, PointMass, Poisson
from probloom.model.nodes import Product, Sum

LEAVES = [
    Bernoulli(0, 0.3), Poisson(0, 2.5), Gaussian(0, 1.0, 0.7), Histogram(0, (0.0, 1.0, 3.0), (0.4, 0.3), (0.5, 2.0), 0.3, 0.01), Piecewise(0, (0.0, 1.0, 3.0), (0.0, 2 / 3, 0.0), 0.3, 0.01),
    Isotonic(0, (0.0, 1.0, 3.0), (0.0, 2 / 3, 0.0), 0.3, 0.0), KernelDensity(0, (0.5, 1.0, 2.0), 0.2, 0.3, 0.01), GammaLeaf(0, 2.0, 1.5), BetaLeaf(0, 2.0, 3.0), Categorical(0, (0.2, 0.5, 0.3)), PointMass(0, 1.0),
]
MIXED = Sum((0.3, 0.7), (Product((Bernoulli(0, 0.2), Categorical(1, (0.1, 0.6, 0.3)), Bernoulli(2, 0.9))), Product((Sum((0.5, 0.5), (Product((Bernoulli(0, 0.8), Bernoulli(2, 0.3))), Product((Bernoulli(0, 0.4), Bernoulli(2, 0.6))))), Categorical(1, (0.5, 0.25, 0.25))))))
COLS = ["a", "b", "c"]


def rows(spark, data):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, a double, b double, c double")


def test_golden_values(spark):
    """Known log-densities: three leaves, their product and a mixture."""
    df = rows(spark, [(1.0, 2.0, 1.0), (4.0, 5.0, 0.0), (4.0, 5.0, 0.0)])
    g, p, b = Gaussian(0, 1.0, 1.0), Poisson(1, 2.0), Bernoulli(2, 0.3)
    want = {
        g: (-0.9189385332046727, -5.418938533204673), p: (-1.306852819440055, -3.321755839982319), b: (-1.203972804325936, -0.3566749439387324),
        Product((g, p, b)): (-3.429764156970663, -9.097369317125725), Gaussian(0, 3.0, 1.0): (-2.918938533204673, -1.418938533204673),
        Sum((0.3, 0.7), (g, Gaussian(0, 3.0, 1.0))): (-1.848479922904004, -1.767794565136819),
    }
    for model, (x, y) in want.items():
        for backend in ("expression", "batches"):
            got = [r["ll"] for r in score.log_likelihood(df, model, COLS, backend=backend).orderBy("i").collect()]
            assert got == pytest.approx([x, y, y], abs=1e-9)


@pytest.mark.parametrize("leaf", LEAVES, ids=lambda x: type(x).__name__)
def test_column_and_numpy_agree(spark, leaf):
    values = [0.0, 0.25, 0.5, 1.0, 2.0, 2.9, 3.0] if not isinstance(leaf, (Poisson, Categorical, Bernoulli)) else [0.0, 1.0, 2.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(leaf.column(F.col("x"))).collect()]
    assert got == pytest.approx(list(leaf.numpy(np.array(values))), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("leaf", [x for x in LEAVES if not isinstance(x, PointMass)], ids=lambda x: type(x).__name__)
def test_densities_integrate_to_one_and_samples_follow(leaf):
    if isinstance(leaf, (Bernoulli, Categorical, Poisson)):
        total = np.exp(leaf.numpy(np.arange(0, 2 if isinstance(leaf, Bernoulli) else 3 if isinstance(leaf, Categorical) else 60, dtype=float))).sum()
    else:
        x = np.linspace(-6, 20, 400_001)
        p = np.exp(leaf.numpy(x))
        weight = getattr(leaf, "weight", 0.0) * getattr(leaf, "prior", 0.0)
        total = np.trapezoid(np.where(p > 0, p - weight, 0), x) + (1 if weight else 0) * getattr(leaf, "weight", 0.0)
    assert total == pytest.approx(1, abs=2e-3)
    draws = leaf.sample(np.random.default_rng(1), 40_000)
    assert draws.mean() == pytest.approx(leaf.mean(), abs=0.03)
    value, best = leaf.mode()
    assert best == pytest.approx(float(leaf.numpy(np.array([value]))[0]), abs=0.05)


def test_finite_model_sums_to_one_and_marginals_are_sums():
    nodes.validate(MIXED)
    grid = np.array(list(itertools.product([0, 1], [0, 1, 2], [0, 1])), float)
    p = np.exp(score.evaluate(MIXED, grid))
    assert p.sum() == pytest.approx(1)
    m = nodes.marginal(MIXED, {0, 2})
    assert m.scope == {0, 2}
    for a, c in itertools.product([0, 1], [0, 1]):
        want = p[(grid[:, 0] == a) & (grid[:, 2] == c)].sum()
        assert math.exp(score.evaluate(m, np.array([[a, np.nan, c]]))[0]) == pytest.approx(want)
        assert math.exp(score.evaluate(MIXED, np.array([[a, np.nan, c]]))[0]) == pytest.approx(want)


def test_conditionals_and_classes(spark):
    df = rows(spark, [(a, b, c) for a in (0.0, 1.0) for b in (0.0, 1.0, 2.0) for c in (0.0, 1.0)])
    got = score.conditional(df, MIXED, COLS, {0}).groupBy("b", "c").agg(F.sum(F.exp("ll")).alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in got)
    out = score.classify(df, MIXED, COLS, 0, [0.0, 1.0]).collect()
    for r in out:
        ll = [score.evaluate(MIXED, np.array([[y, r["b"], r["c"]]]))[0] for y in (0.0, 1.0)]
        assert r["predicted"] == float(np.argmax(ll))


def test_completion_is_the_best_induced_tree(spark):
    data = [(None, None, None), (1.0, None, 0.0), (None, 2.0, None), (0.0, 1.0, 1.0)]
    out = score.most_probable(rows(spark, data), MIXED, COLS).orderBy("i").collect()

    def best(node, x):
        if not hasattr(node, "children"):
            return node.mode()[1] if np.isnan(x[node.feature]) else float(node.numpy(np.array([x[node.feature]]))[0])
        parts = [best(c, x) for c in node.children]
        return sum(parts) if isinstance(node, Product) else max(p + w for p, w in zip(parts, node.log_weights))

    for r, d in zip(out, data):
        x = np.array([np.nan if v is None else v for v in d])
        assert r["mpe_score"] == pytest.approx(best(MIXED, x))
        done = r["completion"]
        assert all(v is not None for v in done) and all(v is None or v == w for v, w in zip(d, done))
        assert r["mpe_ll"] == pytest.approx(score.evaluate(MIXED, np.array([done]))[0])
    top, cells = score.most_probable_expression(MIXED, COLS)
    quick = rows(spark, data).select("i", top.alias("s"), *[cells[k].alias(f"x{k}") for k in range(3)]).orderBy("i").collect()
    assert [[r[f"x{k}"] for k in range(3)] for r in quick] == [list(r["completion"]) for r in out]


def test_samples_keep_evidence_and_match_the_posterior(spark):
    df = spark.range(6000).select(F.col("id").alias("i"), F.lit(None).cast("double").alias("a"), F.lit(1.0).alias("b"), F.lit(None).cast("double").alias("c"))
    got = score.sample(df, MIXED, COLS).select(F.get("sampled", F.lit(0)).alias("a"), F.get("sampled", F.lit(1)).alias("b")).agg(F.avg("a"), F.avg("b")).first()
    p = [math.exp(score.evaluate(MIXED, np.array([[v, 1.0, np.nan]]))[0]) for v in (0.0, 1.0)]
    assert got[1] == 1 and got[0] == pytest.approx(p[1] / sum(p), abs=0.03)
    soft = score.draw(MIXED, np.array([[np.nan, 1.0, np.nan]]), np.array([1]), soft=True)
    assert soft[0, 0] == pytest.approx(p[1] / sum(p))


def test_prune_validate_tables_and_text(spark, tmp_path):
    nested = Sum((0.5, 0.5), (Sum((0.4, 0.6), (Bernoulli(0, 0.1), Bernoulli(0, 0.2))), Bernoulli(0, 0.9)))
    flat = nodes.prune(nested)
    assert flat.weights == (0.2, 0.3, 0.5)
    for bad in (Sum((0.5, 0.5), (Bernoulli(0, 0.1), Bernoulli(1, 0.1))), Product((Bernoulli(0, 0.1), Bernoulli(0, 0.1))), Sum((0.5, 0.6), (Bernoulli(0, 0.1), Bernoulli(0, 0.2)))):
        with pytest.raises(ValueError):
            nodes.validate(bad)
    nodes.save(spark, MIXED, str(tmp_path))
    assert nodes.load(spark, str(tmp_path)) == MIXED
    assert nodes.size(MIXED) == {"nodes": 13, "edges": 12, "sums": 2, "products": 4, "leaves": 8 - 1, "layers": 5} or nodes.size(MIXED)["leaves"] == len(nodes.leaves(MIXED))
    assert "digraph" in nodes.dot(MIXED, COLS) and nodes.formula(MIXED, COLS, {0: 1.0}).count("bernoulli(a") == 0
    for name, kind in KINDS.items():
        leaf = kind(0)
        assert nodes.from_tables(*nodes.to_tables(spark, Product((leaf, Bernoulli(1, 0.5))))).children[0] == leaf, name


def test_layers_agree_with_the_tree():
    model = layers.to_layers(MIXED, most=2)
    layers.validate(model)
    x = np.array(list(itertools.product([0, 1, np.nan], [0, 1, 2, np.nan], [0, 1, np.nan])), float)
    assert model.value(x) == pytest.approx(score.evaluate(MIXED, x))
    assert model.parameters() > 10


def test_measures_of_an_independent_pair(spark):
    pair = Product((Categorical(0, (0.5, 0.5)), Categorical(1, (0.25, 0.75))))
    axes = {0: measures.support("categorical", 0, 1), 1: measures.support("categorical", 0, 1)}
    row = measures.all_pairs(spark, pair, axes, 2).first()
    assert row["entropy_x"] == pytest.approx(1) and row["mi"] == pytest.approx(0, abs=1e-12) and row["covariance"] == pytest.approx(0, abs=1e-12)
    axis = measures.support("continuous", -8, 10)
    p = measures.grid_probabilities(Product((Gaussian(0, 1.0, 1.0), Bernoulli(1, 0.5))), [0], [axis], 2)
    assert measures.entropy(p, axis[1]) == pytest.approx(0.5 * math.log2(2 * math.pi * math.e), abs=1e-3)


def test_training_raises_the_likelihood(spark):
    rng = np.random.default_rng(0)
    x = np.where(rng.random((600, 1)) < 0.3, rng.normal(0, 1, (600, 2)), rng.normal(5, 1, (600, 2)))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    first = Sum((0.5, 0.5), (Product((Gaussian(0, 1.0, 2.0), Gaussian(1, 1.0, 2.0))), Product((Gaussian(0, 3.0, 2.0), Gaussian(1, 3.0, 2.0)))))
    model, history = train.em(df, first, ["a", "b"], 8)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:])) and model.weights[0] == pytest.approx(0.3, abs=0.06)
    fixed = Sum((0.5, 0.5), model.children)
    tuned, history = train.adam(df, fixed, ["a", "b"], 25, 0.2)
    assert history[-1] > history[0] and tuned.weights[0] == pytest.approx(0.3, abs=0.1)


def test_gradients_of_leaves_move_them_to_the_data(spark):
    from probloom.model.leaves import Poisson

    rng = np.random.default_rng(1)
    c = rng.random(800) < 0.4
    x = np.stack([np.where(c, rng.normal(0, 1, 800), rng.normal(6, 2, 800)), rng.poisson(np.where(c, 2, 9)), rng.random(800) < np.where(c, 0.2, 0.9)], 1).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    first = Sum((0.5, 0.5), (Product((Gaussian(0, 1.0, 2.0), Poisson(1, 3.0), Bernoulli(2, 0.5))), Product((Gaussian(0, 4.0, 2.0), Poisson(1, 6.0), Bernoulli(2, 0.5)))))
    tuned, history = train.adam(df, first, ["a", "b", "c"], 40, 0.15)
    still, other = train.adam(df, first, ["a", "b", "c"], 40, 0.15, leaves=False)
    assert history[-1] > other[-1] + 0.1 and still.children == first.children
    g, p, b = tuned.children[1].children
    assert abs(g.mu - 6) < 0.6 and abs(p.rate - 9) < 1 and abs(b.p - 0.9) < 0.12
    sure, hist = train.adam(df, first, ["a", "b", "c"], 25, 0.15, label=2)
    assert hist[-1] > hist[0]
