"""Queries of the models: densities, likelihood, marginals, completion, sampling, learning, measures, streams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probloom.functions import scalar as S
from probloom.model import layers as Y
from probloom.model import learn as L
from probloom.model import measures as M
from probloom.model import nodes as N
from probloom.model import score, train
from probloom.model.leaves import BetaLeaf, Categorical, GammaLeaf, Gaussian, Histogram, KernelDensity, Leaf, Piecewise, PointMass, Poisson
from probloom.model.networks import DependencyNetwork
from probloom.model.nodes import Product, Sum
from probloom.operators import dependence, folds
from probloom.plans.catalog import query
from probloom.plans.tables import _glass, user_counts
from probloom.runtime import stored, table
from probloom.schema import features_of, known
from probloom.streaming import scoring


def r(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


# --- the flagship: a mixture over return flags, fitted and scored -------------------


def flag_mixture(spark: SparkSession, d: str) -> Sum:
    """One aggregation: a component per return flag, Gaussian quantity and price."""
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mq"), F.stddev_pop("l_quantity").alias("sq"), F.avg("l_extendedprice").alias("mp"), F.stddev_pop("l_extendedprice").alias("sp")
    ).orderBy("l_returnflag").collect()
    total = sum(x["n"] for x in g)
    parts = tuple(Product((Gaussian(0, x["mq"], max(x["sq"], 0.4)), Gaussian(1, x["mp"], max(x["sp"], 0.4)))) for x in g)
    return Sum(tuple(x["n"] / total for x in g), parts)


FLAGS = """g AS (SELECT l_returnflag, count(*)::DOUBLE AS n, avg(l_quantity) AS mq, greatest(stddev_pop(l_quantity), 0.4) AS sq, avg(l_extendedprice) AS mp, greatest(stddev_pop(l_extendedprice), 0.4) AS sp FROM lineitem GROUP BY 1),
    p AS (SELECT list({'w': ln(n / (SELECT sum(n) FROM g)), 'mq': mq, 'sq': sq, 'mp': mp, 'sp': sp}) AS ps FROM g)"""
QUANTITY_LL = "- (l_quantity - k.mq) * (l_quantity - k.mq) / (2 * k.sq * k.sq) - 0.5 * ln(2 * pi() * k.sq * k.sq)"
PRICE_LL = "- (l_extendedprice - k.mp) * (l_extendedprice - k.mp) / (2 * k.sp * k.sp) - 0.5 * ln(2 * pi() * k.sp * k.sp)"
LSE = "list_max(t) + ln(list_sum(list_transform(t, lambda v: exp(v - list_max(t)))))"


@query("mixture_loglik", f"WITH {FLAGS}, x AS (SELECT l_orderkey, l_linenumber, list_transform(ps, lambda k: k.w {QUANTITY_LL} {PRICE_LL}) AS t FROM lineitem, p) SELECT l_orderkey, l_linenumber, round({LSE}, 6) AS ll FROM x")
def mixture_loglik(spark: SparkSession, d: str) -> DataFrame:
    x = score.log_likelihood(table(spark, d, "lineitem"), flag_mixture(spark, d), ["l_quantity", "l_extendedprice"])
    return x.select("l_orderkey", "l_linenumber", r("ll").alias("ll"))


@query("mixture_marginal", f"WITH {FLAGS}, x AS (SELECT l_orderkey, l_linenumber, list_transform(ps, lambda k: k.w {QUANTITY_LL}) AS t FROM lineitem, p) SELECT l_orderkey, l_linenumber, round({LSE}, 6) AS ll FROM x")
def mixture_marginal(spark: SparkSession, d: str) -> DataFrame:
    m = N.marginal(flag_mixture(spark, d), {0})
    x = score.log_likelihood(table(spark, d, "lineitem"), m, ["l_quantity", "l_extendedprice"])
    return x.select("l_orderkey", "l_linenumber", r("ll").alias("ll"))


@query("mixture_conditional", f"WITH {FLAGS}, x AS (SELECT l_orderkey, l_linenumber, list_transform(ps, lambda k: k.w {QUANTITY_LL} {PRICE_LL}) AS j, list_transform(ps, lambda k: k.w {PRICE_LL}) AS m FROM lineitem, p) SELECT l_orderkey, l_linenumber, round({LSE.replace('(t', '(j')} - ({LSE.replace('(t', '(m')}), 6) AS ll FROM x")
def mixture_conditional(spark: SparkSession, d: str) -> DataFrame:
    x = score.conditional(table(spark, d, "lineitem"), flag_mixture(spark, d), ["l_quantity", "l_extendedprice"], {0})
    return x.select("l_orderkey", "l_linenumber", r("ll").alias("ll"))


# --- densities ------------------------------------------------------------------------


@query("count_densities", "SELECT l_orderkey, round(l_quantity * ln(25) - 25 - lgamma(l_quantity + 1), 7) AS log_poisson, round(exp(l_quantity * ln(25) - 25 - lgamma(l_quantity + 1)), 9) AS poisson, round(lgamma(l_quantity + 1), 7) AS log_factorial, CASE WHEN l_linestatus = 'O' THEN 0.3 ELSE 0.7 END AS bernoulli, round(CASE WHEN l_linestatus = 'O' THEN ln(0.3) ELSE ln(0.7) END, 9) AS log_bernoulli FROM lineitem")
def count_densities(spark: SparkSession, d: str) -> DataFrame:
    q, o = F.col("l_quantity"), (F.col("l_linestatus") == "O").cast("int")
    return table(spark, d, "lineitem").select(
        "l_orderkey", r(S.log_poisson(q, 25.0), 7).alias("log_poisson"), r(S.poisson(q, 25.0), 9).alias("poisson"), r(S.log_factorial(q), 7).alias("log_factorial"),
        r(S.bernoulli(o, 0.3), 9).alias("bernoulli"), r(S.log_bernoulli(o, 0.3), 9).alias("log_bernoulli"),
    )


C_GAMMA, C_BETA, C_DIR = 2 * math.log(0.1) - math.lgamma(2), math.lgamma(5.5) - math.lgamma(2) - math.lgamma(3.5), math.lgamma(6) - math.lgamma(2) - math.lgamma(3) - math.lgamma(1)


@query("continuous_densities", f"WITH s AS (SELECT l_orderkey, l_quantity AS q, l_quantity / (l_quantity + l_linenumber + 1.0) AS a, l_linenumber / (l_quantity + l_linenumber + 1.0) AS b, 1.0 / (l_quantity + l_linenumber + 1.0) AS c FROM lineitem) SELECT l_orderkey, round(greatest(exp(-(q - 20) * (q - 20) / 50) / sqrt(2 * pi() * 25), 0), 9) AS gaussian, round(-(q - 20) * (q - 20) / 50 - 0.5 * ln(2 * pi() * 25), 7) AS log_gaussian, round(exp({C_GAMMA} + ln(q) - 0.1 * q), 9) AS gamma, round(exp({C_BETA} + ln(a) + 2.5 * ln(1 - a)), 9) AS beta, round({C_DIR} + ln(a) + 2 * ln(b), 7) AS log_dirichlet FROM s")
def continuous_densities(spark: SparkSession, d: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    t = q + n + 1.0
    return table(spark, d, "lineitem").select(
        "l_orderkey", r(S.gaussian(q, 20.0, 25.0), 9).alias("gaussian"), r(S.log_gaussian(q, 20.0, 25.0), 7).alias("log_gaussian"), r(S.gamma_pdf(q, 2.0, 0.1), 9).alias("gamma"),
        r(S.beta_pdf(q / t, 2.0, 3.5), 9).alias("beta"), r(S.log_dirichlet([q / t, n / t, 1.0 / t], [2.0, 3.0, 1.0]), 7).alias("log_dirichlet"),
    )


@query("chi_square_tails", "SELECT event_id, round(exp(-value / 2) * (1 + value / 2), 8) AS sf, round(1 - exp(-value / 2) * (1 + value / 2), 8) AS cdf FROM events WHERE value >= 0")
def chi_square_tails(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value >= 0")
    k = F.lit(4.0)
    return e.select("event_id", r(S.chi2_sf(F.col("value"), k), 8).alias("sf"), r(S.chi2_cdf(F.col("value"), k), 8).alias("cdf"))


LEAVES: dict[str, Leaf] = {
    "histogram": Histogram(0, (0.0, 10.0, 20.0, 50.0), (0.02, 0.05, 0.01), (5.0, 15.0, 35.0), 0.02, 0.01),
    "piecewise": Piecewise(0, (0.0, 20.0, 60.0), (0.0, 1 / 30, 0.0), 0.02, 0.01),
    "gamma": GammaLeaf(0, 3.0, 0.2),
    "categorical": Categorical(0, tuple(float(i + 1) / 1326 for i in range(51))),
    "point": PointMass(0, 7.0),
    "poisson": Poisson(0, 20.0),
    "gaussian": Gaussian(0, 25.0, 9.0),
}


@query("leaf_densities", "SELECT l_orderkey, " + ", ".join(f"round({v.sql('l_quantity')}, 7) AS {k}" for k, v in LEAVES.items()) + " FROM lineitem")
def leaf_densities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", *[r(v.column(F.col("l_quantity")), 7).alias(k) for k, v in LEAVES.items()])


KERNELS = (0.01, 0.03, 0.05, 0.08)


@query("kernel_density", "SELECT l_orderkey, round(ln(0.01 * 10 + 0.99 * (" + " + ".join(f"exp(-(l_discount - {p}) * (l_discount - {p}) / (2 * 0.02 * 0.02))" for p in KERNELS) + f") / ({len(KERNELS)} * 0.02 * sqrt(2 * pi()))), 7) AS log_density FROM lineitem")
def kernel_density(spark: SparkSession, d: str) -> DataFrame:
    leaf = KernelDensity(0, KERNELS, 0.02, 10.0, 0.01)
    return table(spark, d, "lineitem").select("l_orderkey", r(leaf.column(F.col("l_discount")), 7).alias("log_density"))


@query("beta_leaf", f"SELECT l_orderkey, round({BetaLeaf(0, 2.0, 5.0).sql('(l_discount + 0.05)')}, 7) AS log_density FROM lineitem")
def beta_leaf(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", r(BetaLeaf(0, 2.0, 5.0).column(F.col("l_discount") + 0.05), 7).alias("log_density"))


# --- a fixed mixed model: status (0/1), line number, quantity, discount ---------------

FIXED = Sum(
    (0.35, 0.65),
    (
        Product((Categorical(0, (0.8, 0.2)), Categorical(1, (0.0, 0.3, 0.25, 0.15, 0.1, 0.1, 0.05, 0.05)), Sum((0.5, 0.5), (Product((Gaussian(2, 15.0, 6.0), Gaussian(3, 0.4, 0.5))), Product((Poisson(2, 30.0), Gaussian(3, 1.2, 0.4))))))),
        Product((Categorical(0, (0.3, 0.7)), Poisson(1, 3.0), Histogram(2, (0.0, 20.0, 40.0, 60.0), (0.01, 0.03, 0.01), (10.0, 30.0, 50.0), 0.02, 0.01), Gaussian(3, 0.2, 0.45))),
    ),
)
NAMES = ["status", "line", "quantity", "discount"]
ITEMS = "SELECT l_orderkey, (l_linestatus = 'O')::INT::DOUBLE AS status, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber::DOUBLE END AS line, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_quantity END AS quantity, l_discount * 10 AS discount FROM lineitem"


def items(spark: SparkSession, d: str) -> DataFrame:
    """Line items as rows of the fixed model; some cells are unobserved by rule."""
    return table(spark, d, "lineitem").select(
        "l_orderkey", (F.col("l_linestatus") == "O").cast("double").alias("status"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber").cast("double")).alias("line"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity")).alias("quantity"), (F.col("l_discount") * 10).alias("discount"),
    )


@query("network_loglik", f"SELECT l_orderkey, round({N.sql(FIXED, NAMES)}, 6) AS ll FROM ({ITEMS})")
def network_loglik(spark: SparkSession, d: str) -> DataFrame:
    return score.log_likelihood(items(spark, d), FIXED, NAMES, backend="expression").select("l_orderkey", r("ll").alias("ll"))


@query("network_loglik_batches", f"SELECT l_orderkey, round({N.sql(FIXED, NAMES)}, 6) AS ll FROM ({ITEMS})")
def network_loglik_batches(spark: SparkSession, d: str) -> DataFrame:
    return score.log_likelihood(items(spark, d), FIXED, NAMES, backend="batches").select("l_orderkey", r("ll").alias("ll"))


@query("layer_loglik", f"SELECT l_orderkey, round({N.sql(FIXED, NAMES)}, 6) AS ll FROM ({ITEMS})")
def layer_loglik(spark: SparkSession, d: str) -> DataFrame:
    return Y.log_likelihood(items(spark, d), Y.to_layers(FIXED), NAMES).select("l_orderkey", r("ll").alias("ll"))


@query("network_marginal", f"SELECT l_orderkey, round({N.sql(N.marginal(FIXED, {0, 2}), NAMES)}, 6) AS ll FROM ({ITEMS})")
def network_marginal(spark: SparkSession, d: str) -> DataFrame:
    return score.log_likelihood(items(spark, d), N.marginal(FIXED, {0, 2}), NAMES).select("l_orderkey", r("ll").alias("ll"))


@query("network_conditional", f"SELECT l_orderkey, round({N.sql(FIXED, NAMES)} - ({N.sql(N.marginal(FIXED, {1, 2, 3}), NAMES)}), 6) AS ll FROM ({ITEMS})")
def network_conditional(spark: SparkSession, d: str) -> DataFrame:
    return score.conditional(items(spark, d), FIXED, NAMES, {0}).select("l_orderkey", r("ll").alias("ll"))


JOINT = " UNION ALL ".join(f"SELECT *, {c}.0 AS y, {N.sql(FIXED, [str(float(c)), *NAMES[1:]])} AS j FROM x" for c in (0, 1))


@query("network_classify", f"WITH x AS (SELECT row_number() OVER () AS id, * FROM ({ITEMS})), s AS ({JOINT}) SELECT any_value(l_orderkey) AS l_orderkey, arg_max(y, j) AS predicted FROM s GROUP BY id")
def network_classify(spark: SparkSession, d: str) -> DataFrame:
    return score.classify(items(spark, d), FIXED, NAMES, 0, [0.0, 1.0]).select("l_orderkey", "predicted")


PAIR = Sum((0.4, 0.6), (Product((Gaussian(0, 50000.0, 30000.0), Gaussian(1, 300.0, 200.0))), Product((Gaussian(0, 200000.0, 60000.0), Gaussian(1, 900.0, 400.0)))))


def _score(i: int, seen: bool) -> str:
    p = PAIR.children[i]
    a = p.children[0].sql("o_totalprice") if seen else f"({p.children[0].mode()[1]!r}::DOUBLE)"
    return f"({PAIR.log_weights[i]!r}::DOUBLE + {a} + {p.children[1].sql('k')})"


BEST = f"CASE WHEN gone THEN ({_score(0, False)} >= {_score(1, False)}) ELSE ({_score(0, True)} >= {_score(1, True)}) END"
ORDERS = "SELECT o_orderkey, o_totalprice, (o_custkey % 1500)::DOUBLE AS k, o_orderkey % 4 = 0 AS gone FROM orders"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("price"), (F.col("o_custkey") % 1500).cast("double").alias("k"))


@query("network_completion", f"SELECT o_orderkey, round(CASE WHEN gone THEN CASE WHEN {BEST} THEN 50000.0 ELSE 200000.0 END ELSE o_totalprice END, 4) AS price, round(CASE WHEN gone THEN greatest({_score(0, False)}, {_score(1, False)}) ELSE greatest({_score(0, True)}, {_score(1, True)}) END, 6) AS mpe_score FROM ({ORDERS})")
def network_completion(spark: SparkSession, d: str) -> DataFrame:
    top, cells = score.most_probable_expression(PAIR, ["price", "k"])
    return _orders(spark, d).select("o_orderkey", r(cells[0], 4).alias("price"), r(top).alias("mpe_score"))


@query("network_completion_batches", f"SELECT o_orderkey, round(CASE WHEN gone THEN CASE WHEN {BEST} THEN 50000.0 ELSE 200000.0 END ELSE o_totalprice END, 4) AS price FROM ({ORDERS})")
def network_completion_batches(spark: SparkSession, d: str) -> DataFrame:
    return score.most_probable(_orders(spark, d), PAIR, ["price", "k"]).select("o_orderkey", r(F.get("completion", F.lit(0)), 4).alias("price"))


@query("network_sample")
def network_sample(spark: SparkSession, d: str) -> DataFrame:
    return score.sample(_orders(spark, d), PAIR, ["price", "k"]).select("o_orderkey", F.get("sampled", F.lit(0)).alias("price"))


@query("network_soft_sample")
def network_soft_sample(spark: SparkSession, d: str) -> DataFrame:
    return score.sample(_orders(spark, d), PAIR, ["price", "k"], soft=True).select("o_orderkey", r(F.get("sampled", F.lit(0)), 3).alias("price"))


@query("network_tables")
def network_tables(spark: SparkSession, d: str) -> DataFrame:
    from probloom.operators.graphs import counts

    nodes, edges, _ = N.to_tables(spark, FIXED)
    return counts(nodes, edges)


@query("network_costs", f"SELECT round(-sum(j), 2) AS joint_cost, round(sum(m - j), 2) AS label_cost FROM (SELECT {N.sql(FIXED, NAMES)} AS j, {N.sql(N.marginal(FIXED, {1, 2, 3}), NAMES)} AS m FROM ({ITEMS}))")
def network_costs(spark: SparkSession, d: str) -> DataFrame:
    x = score.log_likelihood(score.log_likelihood(items(spark, d), FIXED, NAMES, "j"), N.marginal(FIXED, {1, 2, 3}), NAMES, "m")
    return x.agg(r(-F.sum("j"), 2).alias("joint_cost"), r(F.sum(F.col("m") - F.col("j")), 2).alias("label_cost"))


# --- measures ---------------------------------------------------------------------------

TWO = Sum((0.3, 0.7), (Product((Poisson(0, 2.0), Poisson(1, 3.0))), Product((Poisson(0, 6.0), Poisson(1, 1.0)))))
GRID = "SELECT x, y, 0.3 * exp(x * ln(2) - 2 - lgamma(x + 1) + y * ln(3) - 3 - lgamma(y + 1)) + 0.7 * exp(x * ln(6) - 6 - lgamma(x + 1) - 1 - lgamma(y + 1)) AS p FROM generate_series(0, 40) a(x), generate_series(0, 40) b(y)"


@query("model_measures", f"WITH g AS ({GRID}), a AS (SELECT x, sum(p) AS p FROM g GROUP BY x), b AS (SELECT y, sum(p) AS p FROM g GROUP BY y), h AS (SELECT (SELECT -sum(p * log2(p)) FROM a) AS hx, (SELECT -sum(p * log2(p)) FROM b) AS hy, (SELECT -sum(p * log2(p)) FROM g WHERE p > 0) AS hxy, (SELECT sum(x * p) FROM a) AS ex, (SELECT sum(y * p) FROM b) AS ey, (SELECT sum(x * y * p) FROM g) AS exy) SELECT round(hx, 6) AS entropy_x, round(hy, 6) AS entropy_y, round(hxy, 6) AS joint_entropy, round(hx + hy - hxy, 6) AS mi, round((hx + hy - hxy) / sqrt(hx * hy), 6) AS nmi, round(hx + hy - 2 * (hx + hy - hxy), 6) AS distance, round((hx + hy - 2 * (hx + hy - hxy)) / hxy, 6) AS normalised_distance, round(ex, 6) AS mean_x, round(ey, 6) AS mean_y, round(exy, 6) AS cross_moment, round(exy - ex * ey, 6) AS covariance FROM h")
def model_measures(spark: SparkSession, d: str) -> DataFrame:
    axis = M.support("discrete", 0, 40)
    return M.all_pairs(spark, TWO, {0: axis, 1: axis}, 2).select(*[r(m).alias(m) for m in M.MEASURES])


# --- learning ------------------------------------------------------------------------------

GLASS = ["ri", "na2o", "mgo", "al2o3", "glass_type"]
GLASS_KINDS = ["continuous"] * 4 + ["categorical"]


def _learned(spark: SparkSession, d: str, **settings: object) -> tuple[DataFrame, N.Node]:
    x = _glass(spark, d).dropna()
    return x, L.learn(x, GLASS, GLASS_KINDS, L.Settings(**settings))


@query("learn_glass")
def learn_glass(spark: SparkSession, d: str) -> DataFrame:
    """Structure learned from glass records; mean likelihood per type."""
    x, model = _learned(spark, d)
    return score.log_likelihood(x, model, GLASS).groupBy("glass_type").agg(F.count(F.lit(1)).alias("n"), r(F.avg("ll"), 4).alias("mean_ll"))


@query("learn_strategies")
def learn_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Mean likelihood and size of models by the other row and column splits."""
    out, x = [], stored(_glass(spark, d).dropna(), "glass")
    for rows, columns in (("random", "none"), ("hyperplane", "ami"), ("conditioning", "stability"), ("modal", "rdc"), ("gower", "distance"), ("dbscan", "ami"), ("rdc_kmeans", "rdc"), ("poisson", "blockwise")):
        model = L.learn(x, GLASS, GLASS_KINDS, L.Settings(rows=rows, columns=columns))
        mean = score.log_likelihood(x, model, GLASS).agg(F.avg("ll")).first()[0]
        out.append((rows, columns, round(float(mean), 4), N.size(model)["nodes"]))
    return spark.createDataFrame(out, "rows string, columns string, mean_ll double, nodes int")


@query("learn_folds")
def learn_folds(spark: SparkSession, d: str) -> DataFrame:
    """Mean test likelihood over three folds of patients without missing numbers."""
    spec = features_of(table(spark, d, "feature_domain"), "pima_indians_diabetes")
    cols = ["bmi", "diabetes_pedigree", "age", "pregnant"]
    x = table(spark, d, "pima_indians_diabetes").select("record_id", *[known(F.col(c), spec[c]).alias(c) for c in cols]).dropDuplicates(["record_id"]).dropna()
    x = stored(folds.k_fold(x, ["record_id"], 3), "folds")
    out = []
    for i in range(3):
        model = L.learn(x.where(F.col("fold") != i), cols, ["continuous", "continuous", "discrete", "discrete"], L.Settings(min_rows=1000, families=("gaussian", "piecewise", "isotonic", "poisson")))
        out.append((i, round(float(score.log_likelihood(x.where(F.col("fold") == i), model, cols).agg(F.avg("ll")).first()[0]), 4), N.size(model)["leaves"]))
    return spark.createDataFrame(out, "fold int, test_ll double, leaves int")


@query("em_training")
def em_training(spark: SparkSession, d: str) -> DataFrame:
    """Mean log-likelihood before each round of expectation-maximisation and of gradient ascent."""
    x = table(spark, d, "orders").select((F.col("o_totalprice") / 1000).alias("a"), (F.col("o_custkey") % 1500 / 10).alias("b"))
    first = Sum((0.5, 0.5), (Product((Gaussian(0, 50.0, 30.0), Gaussian(1, 30.0, 40.0))), Product((Gaussian(0, 300.0, 60.0), Gaussian(1, 90.0, 40.0)))))
    _, a = train.em(x, first, ["a", "b"], 5)
    _, b = train.adam(x, first, ["a", "b"], 5)
    return spark.createDataFrame([("em", i, round(float(v), 5)) for i, v in enumerate(a)] + [("adam", i, round(float(v), 5)) for i, v in enumerate(b)], "method string, round int, mean_ll double")


@query("dependency_networks")
def dependency_networks(spark: SparkSession, d: str) -> DataFrame:
    """Perplexity of Poisson dependency networks over the events of users."""
    x, cols, out = stored(user_counts(spark, d), "user-counts"), ["click", "view", "purchase"], []
    for kind in ("glm", "tree", "boosted"):
        net = DependencyNetwork(cols, kind, 3, 3).fit(x)
        out.append((kind, round(float(net.perplexity(x).first()[0]), 6), net.size()))
    return spark.createDataFrame(out, "kind string, perplexity double, size int")


@query("stability_pvalues")
def stability_pvalues(spark: SparkSession, d: str) -> DataFrame:
    """Stability of the mean count of events of one kind along the others, over all users."""
    cols = ["click", "view", "purchase"]
    x = stored(user_counts(spark, d).withColumn("h", F.xxhash64("user_id")), "user-counts")
    p = dependence.stability_over_rows(x, {0: cols}, ["h", "user_id"])[0]
    return spark.createDataFrame([(a, b, round(float(p[i, j]), 8)) for i, a in enumerate(cols) for j, b in enumerate(cols) if i != j], "a string, b string, p double")


@query("generated_mixture")
def generated_mixture(spark: SparkSession, d: str) -> DataFrame:
    x = folds.generated(spark, 2000, ["normal", "poisson", "categorical", "gamma"], 2)
    return x.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[r(F.avg(f"x{i}"), 4).alias(f"mean_{i}") for i in range(4)])


@query("toy_shapes")
def toy_shapes(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for s in ("two_spirals", "cluster_in_cluster", "moons", "half_kernel", "corners", "outlier"):
        x = folds.toy_shape(spark, s, 400).groupBy("label").agg(F.count(F.lit(1)).alias("n"), r(F.avg("x"), 4).alias("mean_x")).withColumn("shape", F.lit(s))
        out = x if out is None else out.unionByName(x)
    return out


# --- streams -----------------------------------------------------------------------------

EVENT = Sum((0.5, 0.5), (Gaussian(0, 20.0, 15.0), Gaussian(0, 80.0, 30.0)))


@query("stream_windows", f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS rows, round(avg(ll), 6) AS mean_ll, count_if(ll < -5) AS unlikely FROM (SELECT ts, {N.sql(EVENT, ['value'])} AS ll FROM events) GROUP BY 1")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events scored as a stream, counted in daily windows when the files are used up."""
    import uuid

    schema = table(spark, d, "events").schema
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    is_dir = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    stream = scoring.read_stream(spark, f"{d}/events.parquet" if is_dir else d, schema, "*.parquet" if is_dir else "events.parquet")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    out = scoring.unlikely_windows(scoring.score_stream(stream, EVENT, ["value"]), "ts", "ll", -5.0, "1 day")
    name = f"windows_{uuid.uuid4().hex[:8]}"
    q = out.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "rows", r("mean_ll").alias("mean_ll"), "unlikely")
