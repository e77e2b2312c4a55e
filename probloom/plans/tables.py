"""Queries of the table operators: aggregates, histograms, windows, encodings, sets, folds, graphs, distances."""

from __future__ import annotations

from itertools import product as cross

import numpy as np
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probloom.functions import scalar as S
from probloom.operators import dependence, distances, folds, graphs, metrics, ordered, rowsplits
from probloom.operators import histograms as H
from probloom.operators import transforms as P
from probloom.plans.catalog import query
from probloom.runtime import table
from probloom.schema import features_of, known
from probloom.sources import features_file as FF
from probloom.sources import loaders


def r(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


# --- aggregates -----------------------------------------------------------------


@query("slice_moments", "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity, round(greatest(stddev_pop(l_quantity), 0.4), 6) AS sd_quantity, round(var_pop(l_discount), 8) AS var_discount, round(avg((l_linestatus = 'O')::INT), 6) AS success_ratio FROM lineitem GROUP BY 1")
def slice_moments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("l_quantity")).alias("mean_quantity"), r(F.greatest(F.stddev_pop("l_quantity"), F.lit(0.4))).alias("sd_quantity"),
        r(F.var_pop("l_discount"), 8).alias("var_discount"), r(F.avg((F.col("l_linestatus") == "O").cast("double"))).alias("success_ratio"),
    )


@query("column_variances", "SELECT round(var_pop(l_quantity), 5) AS var_quantity, round(var_pop(l_tax), 8) AS var_tax, (var_pop(l_quantity) = 0)::INT + (var_pop(l_tax) = 0)::INT AS constant_columns FROM lineitem")
def column_variances(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "lineitem").agg(F.var_pop("l_quantity").alias("a"), F.var_pop("l_tax").alias("b"))
    return v.select(r("a", 5).alias("var_quantity"), r("b", 8).alias("var_tax"), ((F.col("a") == 0).cast("int") + (F.col("b") == 0).cast("int")).alias("constant_columns"))


@query("domains", "SELECT l_returnflag, list_sort(list_distinct(list(l_linenumber))) AS line_domain, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1")
def domains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.array_sort(F.collect_set("l_linenumber")).alias("line_domain"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


QUANTITY = "SELECT g.i AS bin, g.i + 0.5 AS lo, g.i + 1.5 AS hi, count(l_quantity) AS n FROM generate_series(0, 49) g(i) LEFT JOIN lineitem ON floor(l_quantity - 0.5) = g.i GROUP BY 1"


def quantity_bins(spark: SparkSession, d: str, by: tuple[str, ...] = ()) -> DataFrame:
    return H.histogram(table(spark, d, "lineitem"), "l_quantity", H.domain_edges(1, 50, 1, True), by)


@query("histogram_laplace", f"SELECT bin, lo, hi, n, round((n + 1.0) / (sum(n) OVER () + count(*) OVER ()), 9) AS freq, round(n / (sum(n) OVER () * (hi - lo)), 9) AS density FROM ({QUANTITY})")
def histogram_laplace(spark: SparkSession, d: str) -> DataFrame:
    return H.frequencies(H.with_density(quantity_bins(spark, d)), 1.0).select("bin", "lo", "hi", "n", r("freq", 9).alias("freq"), r("density", 9).alias("density"))


@query("histogram_average", "SELECT b AS bin, round(sum(n) / 3.0, 6) AS n, 3 AS histograms FROM (SELECT floor(l_quantity - 0.5)::INT AS b, count(*) AS n FROM lineitem GROUP BY b, l_returnflag) GROUP BY b")
def histogram_average(spark: SparkSession, d: str) -> DataFrame:
    return H.averaged(quantity_bins(spark, d, ("l_returnflag",)), "l_returnflag").select("bin", r("n").alias("n"), "histograms")


def _quantity_points(spark: SparkSession, d: str) -> DataFrame:
    bins = H.frequencies(quantity_bins(spark, d), 1.0).orderBy("bin").collect()  # one row a domain value
    xs, ys = H.to_piecewise([b["lo"] + 0.5 for b in bins] + [bins[-1]["hi"] + 0.5], [b["freq"] for b in bins], "discrete")
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(xs, ys))], "place int, x double, y double")


POINTS = f"""f AS (SELECT bin, (n + 1.0) / (sum(n) OVER () + 50) AS freq FROM ({QUANTITY})),
    raw AS (SELECT bin + 1 AS place, bin + 1.0 AS x, freq AS y FROM f UNION ALL VALUES (0, 0.0, 0.0), (51, 51.0, 0.0)),
    area AS (SELECT sum(p) AS a FROM (SELECT (x - lag(x) OVER (ORDER BY x)) * (y + lag(y) OVER (ORDER BY x)) / 2 AS p FROM raw)),
    pts AS (SELECT place, x, y / a AS y FROM raw, area)"""


@query("piecewise_points", f"WITH {POINTS} SELECT place, x, round(y, 9) AS y FROM pts")
def piecewise_points(spark: SparkSession, d: str) -> DataFrame:
    return _quantity_points(spark, d).select("place", "x", r("y", 9).alias("y"))


@query("segment_masses", f"WITH {POINTS} SELECT x AS start, round((lead(x) OVER w - x) * (y + lead(y) OVER w) / 2, 9) AS mass FROM pts WINDOW w AS (ORDER BY x) QUALIFY lead(x) OVER w IS NOT NULL")
def segment_masses(spark: SparkSession, d: str) -> DataFrame:
    pts = ordered.pairs_in_order(_quantity_points(spark, d).withColumn("g", F.lit(0)), ["x"], ["x", "y"], ["g"])  # the points of one density
    return pts.select(F.col("x").alias("start"), r((F.col("next_x") - F.col("x")) * (F.col("y") + F.col("next_y")) / 2, 9).alias("mass"))


@query("likelihood_summary", "WITH s AS (SELECT o_orderpriority, -0.5 * ln(2 * pi() * 1e8) - (o_totalprice - 1e5) * (o_totalprice - 1e5) / 2e10 AS ll FROM orders) SELECT o_orderpriority, round(sum(ll), 3) AS sum_ll, round(avg(ll), 6) AS mean_ll, round(min(ll), 6) AS min_ll, round(max(ll), 6) AS max_ll FROM s GROUP BY 1")
def likelihood_summary(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("o_totalprice")
    ll = F.lit(-0.5) * F.ln(F.lit(2e8) * F.pi()) - (x - 1e5) * (x - 1e5) / 2e10
    got = metrics.likelihood_summary("ll", ["o_orderpriority"], table(spark, d, "orders").withColumn("ll", ll))
    return got.select("o_orderpriority", r("sum_ll", 3).alias("sum_ll"), *[r(c).alias(c) for c in ("mean_ll", "min_ll", "max_ll")])


@query("empirical_probability", "SELECT round(avg((l_quantity > 25)::INT), 8) AS p, round(avg((l_quantity > 25 AND l_discount < 0.05)::INT) / avg((l_discount < 0.05)::INT), 8) AS p_given FROM lineitem")
def empirical_probability(spark: SparkSession, d: str) -> DataFrame:
    a, b = (F.col("l_quantity") > 25), (F.col("l_discount") < 0.05)
    share = lambda c: F.avg(c.cast("double"))
    return table(spark, d, "lineitem").agg(r(share(a), 8).alias("p"), r(share(a & b) / share(b), 8).alias("p_given"))


@query("perplexity", "SELECT event_type, round(pow(2, -(sum(-value) / sum(1 + user_id % 5))), 8) AS perplexity FROM events GROUP BY 1")
def perplexity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(r(metrics.perplexity(-F.col("value"), 1 + F.col("user_id") % 5), 8).alias("perplexity"))


@query("errors", "SELECT round((avg(abs(l_discount - l_tax)) + avg(abs(l_quantity - 25))) / 2, 7) AS mae, round((avg((l_discount - l_tax) * (l_discount - l_tax)) + avg((l_quantity - 25) * (l_quantity - 25))) / 2, 6) AS mse FROM lineitem")
def errors(spark: SparkSession, d: str) -> DataFrame:
    mae, mse = metrics.errors([F.col("l_discount"), F.col("l_quantity")], [F.col("l_tax"), F.lit(25.0)])
    return table(spark, d, "lineitem").agg(r(mae, 7).alias("mae"), r(mse).alias("mse"))


LABELS = "SELECT l_linenumber AS t, (1 + (l_partkey + l_suppkey) % 7)::INT AS p FROM lineitem"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_linenumber").alias("t"), (1 + (F.col("l_partkey") + F.col("l_suppkey")) % 7).cast("int").alias("p"))


@query("classification_scores", f"WITH x AS ({LABELS}), l AS (SELECT DISTINCT t AS k FROM x UNION SELECT DISTINCT p FROM x), c AS (SELECT k, count_if(t = k AND p = k) AS tp, count_if(t = k) AS re, count_if(p = k) AS sa FROM x, l GROUP BY k) SELECT round(sum(tp) / sum(re), 8) AS accuracy, round(avg(2 * tp / (re + sa)), 8) AS macro_f1, round(2 * sum(tp) / sum(re + sa), 8) AS micro_f1 FROM c")
def classification_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.classification(_labels(spark, d), "t", "p").select(*[r(c, 8).alias(c) for c in ("accuracy", "macro_f1", "micro_f1")])


@query("confusion", f"SELECT t, p, count(*) AS n, round(count(*) / max(count(*)) OVER (), 8) AS share_of_max FROM ({LABELS}) GROUP BY t, p")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_labels(spark, d), "t", "p").select("t", "p", "n", r("share_of_max", 8).alias("share_of_max"))


@query("multilabel_scores", "WITH x AS (SELECT l_linenumber % 2 AS a, (l_linenumber < 4)::INT AS b, (l_quantity > 25)::INT AS u, (l_discount > 0.05)::INT AS v FROM lineitem) SELECT round(avg((a = u AND b = v)::INT), 8) AS exact_match, round(avg((a = u)::INT + (b = v)::INT) / 2, 8) AS one_minus_hamming, round(avg(CASE WHEN greatest(a, u) + greatest(b, v) = 0 THEN 1 ELSE (a * u + b * v) / (greatest(a, u) + greatest(b, v)) END), 8) AS jaccard FROM x")
def multilabel_scores(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select((F.col("l_linenumber") % 2).alias("a"), (F.col("l_linenumber") < 4).cast("int").alias("b"), (F.col("l_quantity") > 25).cast("int").alias("u"), (F.col("l_discount") > 0.05).cast("int").alias("v"))
    return metrics.multilabel(x, ["a", "b"], ["u", "v"]).select(*[r(c, 8).alias(c) for c in ("exact_match", "one_minus_hamming", "jaccard")])


_LABELS = "SELECT l_linenumber % 2 AS a, (l_linenumber < 4)::INT AS b, (l_quantity > 25)::INT AS u, (l_discount > 0.05)::INT AS v, l_quantity AS s, l_extendedprice AS t FROM lineitem"


@query("multilabel_f1", f"WITH x AS ({_LABELS}) SELECT round(2.0 * (sum(a * u) + sum(b * v)) / (sum(a + u) + sum(b + v)), 8) AS micro_f1, round((2.0 * sum(a * u) / sum(a + u) + 2.0 * sum(b * v) / sum(b + v)) / 2, 8) AS macro_f1 FROM x")
def multilabel_f1(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select((F.col("l_linenumber") % 2).alias("a"), (F.col("l_linenumber") < 4).cast("int").alias("b"), (F.col("l_quantity") > 25).cast("int").alias("u"), (F.col("l_discount") > 0.05).cast("int").alias("v"))
    return metrics.multilabel_f1(x, ["a", "b"], ["u", "v"]).select(*[r(c, 8).alias(c) for c in ("micro_f1", "macro_f1")])


@query(
    "multilabel_precision",
    f"WITH x AS ({_LABELS}), c AS (SELECT 'a' AS l, a AS y, s FROM x UNION ALL SELECT 'b', b, t FROM x), g AS (SELECT l, y, s FROM c UNION ALL SELECT 'micro', y, s FROM c), p AS (SELECT l, s, sum(y) AS tp, count(*) AS n FROM g GROUP BY l, s), "
    "k AS (SELECT l, tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM p WINDOW w AS (PARTITION BY l ORDER BY s DESC)), e AS (SELECT l, sum(tp * ctp / cn) / sum(tp) AS ap FROM k GROUP BY l) "
    "SELECT CASE WHEN l = 'micro' THEN 'micro' ELSE 'macro' END AS kind, round(avg(ap), 8) AS average_precision FROM e GROUP BY 1",
)
def multilabel_precision(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select((F.col("l_linenumber") % 2).alias("a"), (F.col("l_linenumber") < 4).cast("int").alias("b"), "l_quantity", "l_extendedprice")
    return metrics.multilabel_precision(x, ["a", "b"], ["l_quantity", "l_extendedprice"]).select("kind", r("average_precision", 8).alias("average_precision"))


@query("improvement_summary", "SELECT c_mktsegment, round(avg((c_acctbal - 500) / 500 * 100), 6) AS mean_gain, round(stddev_pop((c_acctbal - 500) / 500 * 100), 6) AS std_gain FROM customer GROUP BY 1")
def improvement_summary(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "customer").withColumn("base", F.lit(500.0))
    return metrics.improvement_summary(x, "c_acctbal", "base", ["c_mktsegment"]).select("c_mktsegment", r("mean_gain").alias("mean_gain"), r("std_gain").alias("std_gain"))


@query("class_filter", "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber NOT IN (2, 5) GROUP BY 1")
def class_filter(spark: SparkSession, d: str) -> DataFrame:
    return P.without_classes(table(spark, d, "lineitem"), "l_linenumber", [2, 5]).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("log_counts", "SELECT round(sum(ln(1 + l_quantity)), 4) AS logs, round(sum(sqrt(l_quantity)), 4) AS roots FROM lineitem")
def log_counts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return x.select(*P.log_counts(["l_quantity"]), P.log_counts(["l_quantity"], True)[0].alias("root")).agg(r(F.sum("l_quantity"), 4).alias("logs"), r(F.sum("root"), 4).alias("roots"))


@query("exact_quantiles", "SELECT round(quantile_cont(l_extendedprice, 0.1), 6) AS q10, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.99), 6) AS q99 FROM lineitem")
def exact_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = P.exact_quantiles(table(spark, d, "lineitem"), "l_extendedprice", [0.1, 0.5, 0.99])
    return spark.createDataFrame([tuple(round(float(v), 6) for v in q)], "q10 double, q50 double, q99 double")


def _fixed_features(u: str, w: list, b: list) -> list[str]:
    return [f"sin({u} * {x} + {y})" for x, y in zip(w, b)]


#: Weights (value, constant) of two columns' features, fixed so that SQL can state the coefficient.
_W = [([0.11, -0.07], [0.05, 0.14]), ([-0.09, 0.13], [0.12, -0.03])]


def _coefficient_sql() -> str:
    f = [*_fixed_features("u", *_W[0]), *_fixed_features("v", *_W[1])]
    cov = ", ".join(f"covar_pop(f{i}, f{j}) AS c{i}{j}" for i in range(4) for j in range(i, 4))
    return f"""WITH r AS (SELECT cume_dist() OVER (ORDER BY l_quantity) AS u, cume_dist() OVER (ORDER BY l_extendedprice) AS v FROM lineitem),
      f AS (SELECT {', '.join(f'{x} AS f{i}' for i, x in enumerate(f))} FROM r), c AS (SELECT {cov} FROM f),
      a AS (SELECT *, c00 * c11 - c01 * c01 AS dx, c22 * c33 - c23 * c23 AS dy FROM c),
      p AS (SELECT (c11 * c02 - c01 * c12) / dx AS p00, (c11 * c03 - c01 * c13) / dx AS p01, (c00 * c12 - c01 * c02) / dx AS p10, (c00 * c13 - c01 * c03) / dx AS p11,
        (c33 * c02 - c23 * c03) / dy AS q00, (c33 * c12 - c23 * c13) / dy AS q01, (c22 * c03 - c23 * c02) / dy AS q10, (c22 * c13 - c23 * c12) / dy AS q11 FROM a),
      m AS (SELECT p00 * q00 + p01 * q10 + p10 * q01 + p11 * q11 AS t, (p00 * p11 - p01 * p10) * (q00 * q11 - q01 * q10) AS d FROM p)
      SELECT round(sqrt(t / 2 + sqrt(greatest(t * t / 4 - d, 0))), 4) AS coefficient FROM m"""


@query("dependence_coefficient", _coefficient_sql())
def dependence_coefficient(spark: SparkSession, d: str) -> DataFrame:
    """The whole randomised dependence coefficient of two columns, from exact ranks."""
    m = dependence.rdc_exact(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], [np.array(w) for w in _W])
    return spark.createDataFrame([(round(float(m[0, 1]), 4),)], "coefficient double")


@query("average_precision", "WITH s AS (SELECT value AS v, sum((event_type = 'click')::INT) AS tp, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY value), c AS (SELECT tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM s WINDOW w AS (ORDER BY v DESC)) SELECT round(sum(tp * ctp / cn) / sum(tp), 8) AS average_precision FROM c")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select((F.col("event_type") == "click").alias("y"), "value")
    return metrics.average_precision(x, "y", "value").select(r("average_precision", 8).alias("average_precision"))


@query("fold_summary", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS folds FROM events GROUP BY 1")
def fold_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.fold_summary(table(spark, d, "events"), "value", ["event_type"]).select("event_type", r("mean").alias("mean"), r("std").alias("std"), "folds")


@query("best_run", "SELECT c_mktsegment, arg_max(c_custkey, c_acctbal)::DOUBLE AS test_of_best FROM customer GROUP BY 1")
def best_run(spark: SparkSession, d: str) -> DataFrame:
    return metrics.best_run(table(spark, d, "customer").withColumn("k", F.col("c_custkey").cast("double")), "c_acctbal", "k", ["c_mktsegment"])


@query("improvement", "WITH b AS (SELECT avg(c_acctbal) AS a FROM customer) SELECT c_nationkey, round((avg(c_acctbal) - any_value(a)) / any_value(a) * 100, 6) AS percent FROM customer, b GROUP BY 1")
def improvement(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    base = c.agg(F.avg("c_acctbal").alias("a"))
    return c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m")).crossJoin(F.broadcast(base)).select("c_nationkey", r(metrics.improvement(F.col("m"), F.col("a"))).alias("percent"))  # one row


@query("not_run", "SELECT count_if(l_discount + l_tax = 0) AS not_run, count(*) AS runs FROM lineitem")
def not_run(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.count_if(F.col("l_discount") + F.col("l_tax") == 0).alias("not_run"), F.count(F.lit(1)).alias("runs"))


@query("correlation", "SELECT round(corr(l_quantity, l_extendedprice), 8) AS c FROM lineitem")
def correlation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(r(F.corr("l_quantity", "l_extendedprice"), 8).alias("c"))


@query("mutual_information", "WITH n AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), m AS (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM n) SELECT round(sum(n / t * ln(n * t / (na * nb))), 8) AS mi, round(-sum(n / t * ln(na / t)), 8) AS entropy_a, round(-sum(n / t * ln(nb / t)), 8) AS entropy_b, round(sum(n / t * ln(n * t / (na * nb))) / sqrt(sum(n / t * ln(na / t)) * sum(n / t * ln(nb / t))), 7) AS nmi FROM m")
def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mutual_information(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select(*[r(c, 8).alias(c) for c in ("mi", "entropy_a", "entropy_b")], r("nmi", 7).alias("nmi"))


@query("bootstrap_counts")
def bootstrap_counts(spark: SparkSession, d: str) -> DataFrame:
    return H.resampled(table(spark, d, "events").select("event_id"), 5).groupBy("resample").agg(F.sum("weight").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"))


@query("irregular_histogram")
def irregular_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Penalised and Bayesian-block histograms of event values over a fine grid."""
    import numpy as np

    e = table(spark, d, "events").where(F.col("value").isNotNull())
    lo, hi = e.agg(F.min("value"), F.max("value")).first()
    edges = H.equal_edges(lo, hi, H.FINE_BINS)
    counts = np.array([b["n"] for b in H.histogram(e, "value", edges).orderBy("bin").collect()], float)
    a, dens = H.irregular(counts, np.array(edges))
    blocks = H.bayesian_blocks(counts, np.array(edges))
    rows = [("penalised", i, float(u), float(v)) for i, (u, v) in enumerate(zip(a, a[1:]))] + [("blocks", i, float(u), float(v)) for i, (u, v) in enumerate(zip(blocks, blocks[1:]))]
    return spark.createDataFrame(rows, "kind string, bin int, lo double, hi double")


# --- order ------------------------------------------------------------------------


@query("ecdf_by_nation", "SELECT c_custkey, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 9) AS ecdf FROM customer")
def ecdf_by_nation(spark: SparkSession, d: str) -> DataFrame:
    return ordered.ecdf(table(spark, d, "customer"), "c_acctbal", by=["c_nationkey"]).select("c_custkey", r("ecdf", 9).alias("ecdf"))


@query("ecdf_whole", "SELECT l_orderkey, l_quantity, round(cume_dist() OVER (ORDER BY l_quantity), 9) AS ecdf FROM lineitem WHERE l_quantity IS NOT NULL")
def ecdf_whole(spark: SparkSession, d: str) -> DataFrame:
    return ordered.ecdf(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), "l_quantity").select("l_orderkey", "l_quantity", r("ecdf", 9).alias("ecdf"))


@query("cumulative_process", "SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey), 2) AS process FROM orders")
def cumulative_process(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(20,4)").alias("p"))
    return ordered.running_sum(o, ["o_orderdate", "o_orderkey"], "p", "s").select("o_orderkey", r(F.col("s").cast("double"), 2).alias("process"))


@query("local_minima", "WITH x AS (SELECT event_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, value FROM x WHERE value < a AND value < b")
def local_minima(spark: SparkSession, d: str) -> DataFrame:
    return ordered.local_minima(table(spark, d, "events"), ["ts", "event_id"], "value", ["user_id"]).select("event_id", "value")


@query("adjacent_pairs", "SELECT event_id, lead(event_id) OVER w AS next_event FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY lead(event_id) OVER w IS NOT NULL")
def adjacent_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ordered.pairs_in_order(table(spark, d, "events"), ["ts", "event_id"], ["event_id"], ["user_id"]).select("event_id", F.col("next_event_id").alias("next_event"))


@query("trapezoid_area", "SELECT user_id, round(coalesce(sum(p), 0), 4) AS area FROM (SELECT user_id, (event_id - lag(event_id) OVER w) * (value + lag(value) OVER w) / 2 AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY 1")
def trapezoid_area(spark: SparkSession, d: str) -> DataFrame:
    return ordered.trapezoid(table(spark, d, "events"), "event_id", "value", ["user_id"]).select("user_id", r("area", 4).alias("area"))


@query("merged_points", "SELECT l_quantity AS x, min(l_linenumber) AS y FROM lineitem GROUP BY 1")
def merged_points(spark: SparkSession, d: str) -> DataFrame:
    return ordered.merged_points(table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_linenumber").alias("y"), F.col("l_linenumber").alias("s")), "x", "y", "s")


@query("top_by_group", "SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def top_by_group(spark: SparkSession, d: str) -> DataFrame:
    return ordered.top_k(table(spark, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "rank")


@query("top_overall", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_overall(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


# --- sets and grids ---------------------------------------------------------------


@query("set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    c, s, n = (table(spark, d, t).select(F.col(k).alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))
    count = lambda df, op: df.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"))
    return count(c.unionByName(s), "union").unionByName(count(c.intersect(s), "intersect")).unionByName(count(n.exceptAll(s.distinct()), "except"))


@query("parameter_grid", "SELECT a.v AS min_rows, b.v AS threshold, c.v AS alpha FROM (VALUES (50), (100), (200)) a(v), (VALUES (0.1), (0.3)) b(v), (VALUES (0), (1)) c(v)")
def parameter_grid(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(cross((50, 100, 200), (0.1, 0.3), (0, 1))), "min_rows int, threshold double, alpha int")


@query("binary_worlds", "SELECT i AS world, list_sum([(i >> k) & 1 FOR k IN range(6)])::INT AS ones FROM generate_series(0, 63) t(i)")
def binary_worlds(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(64).select(F.col("id").alias("world"), F.bit_count("id").cast("int").alias("ones"))


# --- encodings and filters --------------------------------------------------------


@query("one_hot", "SELECT l_orderkey, [(l_returnflag = f)::INT::DOUBLE FOR f IN ['A', 'N', 'R']] AS flags FROM lineitem")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return x.select("l_orderkey", P.one_hot("l_returnflag", P.domain_of(x, "l_returnflag")).alias("flags"))


@query("outlier_filter", "WITH a AS (SELECT l_orderkey, l_extendedprice AS p, l_quantity AS q FROM lineitem WHERE abs(l_quantity - (SELECT median(l_quantity) FROM lineitem)) < 1.5 * (SELECT stddev_pop(l_quantity) FROM lineitem)) SELECT l_orderkey, p, q FROM a WHERE abs(p - (SELECT median(p) FROM a)) < 1.5 * (SELECT stddev_pop(p) FROM a)")
def outlier_filter(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"))
    return P.without_outliers(x, ["q", "p"], 1.5)


@query("complete_cases", "SELECT count(*) AS rows FROM lineitem WHERE l_tax <> 0")
def complete_cases(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_tax", F.lit(0.0).alias("empty"))
    return P.complete_cases(x, ["l_tax", "empty"], 0.0, x.count()).agg(F.count(F.lit(1)).alias("rows"))


@query("simplex", "WITH s AS (SELECT l_orderkey, CASE l_discount WHEN 0 THEN 1e-7 WHEN 1 THEN 1 - 1e-7 ELSE l_discount END AS a, CASE l_tax WHEN 0 THEN 1e-7 WHEN 1 THEN 1 - 1e-7 ELSE l_tax END AS b FROM lineitem) SELECT l_orderkey, round(a / (a + b), 8) AS l_discount, round(b / (a + b), 8) AS l_tax FROM s")
def simplex(spark: SparkSession, d: str) -> DataFrame:
    a, b = P.simplex(["l_discount", "l_tax"])
    return table(spark, d, "lineitem").select("l_orderkey", r(a, 8).alias("l_discount"), r(b, 8).alias("l_tax"))


@query("standardised", "SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS value FROM events")
def standardised(spark: SparkSession, d: str) -> DataFrame:
    return P.standardised(table(spark, d, "events").select("event_id", "value"), ["value"]).select("event_id", r("value").alias("value"))


@query("discretised", "WITH m AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, count(*) AS n, (quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)) / stddev_pop(c_acctbal) AS iqr, min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer), w AS (SELECT *, (a - m) / s AS lo, (b - m) / s AS hi, greatest(1, ceil(((b - a) / s) / (2 * iqr / pow(n, 1.0 / 3)))) AS k FROM m) SELECT c_custkey, (CASE WHEN (c_acctbal - m) / s >= hi THEN k + 1 ELSE least(floor(((c_acctbal - m) / s - lo) / ((hi - lo) / k)) + 1, k) END)::INT AS bin FROM customer, w")
def discretised(spark: SparkSession, d: str) -> DataFrame:
    return P.discretised(table(spark, d, "customer"), "c_acctbal", "bin").select("c_custkey", "bin")


TYPES_OF_USER = "SELECT user_id, count_if(event_type = 'click') AS click, count_if(event_type = 'view') AS view, count_if(event_type = 'purchase') AS purchase FROM events GROUP BY 1"


def user_counts(spark: SparkSession, d: str) -> DataFrame:
    return loaders.dense_counts(table(spark, d, "events").withColumn("one", F.lit(1).cast("long")), "user_id", "event_type", "one", ["click", "view", "purchase"])


@query("item_counts", TYPES_OF_USER)
def item_counts(spark: SparkSession, d: str) -> DataFrame:
    return user_counts(spark, d)


@query("tf_idf", f"WITH c AS ({TYPES_OF_USER}), n AS (SELECT count(*) AS n, count_if(click > 0) AS a, count_if(view > 0) AS b, count_if(purchase > 0) AS c FROM c), w AS (SELECT user_id, click * (ln((1 + n) / (1 + a)) + 1) AS x, view * (ln((1 + n) / (1 + b)) + 1) AS y, purchase * (ln((1 + n) / (1 + c)) + 1) AS z FROM c, n) SELECT user_id, round(CASE WHEN x*x+y*y+z*z > 0 THEN x / sqrt(x*x+y*y+z*z) ELSE 0 END, 7) AS click, round(CASE WHEN x*x+y*y+z*z > 0 THEN y / sqrt(x*x+y*y+z*z) ELSE 0 END, 7) AS view, round(CASE WHEN x*x+y*y+z*z > 0 THEN z / sqrt(x*x+y*y+z*z) ELSE 0 END, 7) AS purchase FROM w")
def tf_idf(spark: SparkSession, d: str) -> DataFrame:
    return P.tf_idf(user_counts(spark, d), ["click", "view", "purchase"]).select("user_id", *[r(c, 7).alias(c) for c in ("click", "view", "purchase")])


@query("label_rules", "SELECT l_orderkey, " + ", ".join(f"(l_linenumber IN {v})::INT AS {k}" for k, v in P.DIGIT_RULES.items()) + " FROM lineitem")
def label_rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", *P.label_rules("l_linenumber"))


IMAGES = "SELECT image_id, any_value(pixel_data::DOUBLE[]) AS p FROM cifar10_batches WHERE len(pixel_data) = 3072 AND len(list_filter(pixel_data, lambda x: x IS NOT NULL)) = 3072 GROUP BY 1"


def _images(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "cifar10_batches").where((F.size("pixel_data") == 3072) & ~F.exists("pixel_data", lambda v: v.isNull()))
    return x.select("image_id", "pixel_data").dropDuplicates(["image_id"])


@query("gray_images", f"SELECT image_id, round(list_avg([0.2989 * p[i] + 0.5870 * p[i + 1024] + 0.1140 * p[i + 2048] FOR i IN range(1, 1025)]), 5) AS mean_gray FROM ({IMAGES})")
def gray_images(spark: SparkSession, d: str) -> DataFrame:
    mean = F.aggregate(P.gray(F.col("pixel_data")), F.lit(0.0), lambda a, v: a + v) / 1024
    return _images(spark, d).select("image_id", r(mean, 5).alias("mean_gray"))


@query("image_halves", f"SELECT image_id, round(list_avg([p[i] FOR i IN range(1, 1025) IF (i - 1) % 32 < 16]), 5) AS left_red, round(list_avg(p[513:1024]), 5) AS lower_red FROM ({IMAGES})")
def image_halves(spark: SparkSession, d: str) -> DataFrame:
    red = F.transform(F.slice("pixel_data", 1, 1024), lambda v: v.cast("double"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / 512
    return _images(spark, d).select("image_id", r(mean(P.half_mask(red, 32, "left")), 5).alias("left_red"), r(mean(P.half_mask(red, 32, "down")), 5).alias("lower_red"))


WORDS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM documents WHERE text IS NOT NULL"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.explode(S.words(F.col("text"))).alias("token"))


@query("token_frequency", f"SELECT token, count(*) AS total, token IN ('the', 'rows') AS is_last FROM ({WORDS}) GROUP BY 1 HAVING count(*) > 20 OR token IN ('the', 'rows')")
def token_frequency(spark: SparkSession, d: str) -> DataFrame:
    return P.informative(_tokens(spark, d).withColumn("one", F.lit(1)), "token", "one", 20, ["the", "rows"])


@query("vocabulary")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Count vectors over the hundred most frequent words found in at least two and at most 95 % of the documents."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", S.words(F.col("text"), ["the", "of", "and", "a"]).alias("words"))
    model = CountVectorizer(inputCol="words", outputCol="counts", minDF=2, maxDF=0.95, vocabSize=100).fit(docs)
    return spark.createDataFrame([(i, w) for i, w in enumerate(model.vocabulary)], "place int, word string")


@query("topics")
def topics(spark: SparkSession, d: str) -> DataFrame:
    """Most telling words of five topics; every document enters every round."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", S.words(F.col("text")).alias("words"))
    words = CountVectorizer(inputCol="words", outputCol="features", minDF=2, maxDF=0.95, vocabSize=200).fit(docs)
    model = LDA(k=5, maxIter=8, seed=11, optimizer="online", subsamplingRate=1.0).fit(words.transform(docs).select("features"))
    names = F.array(*[F.lit(w) for w in words.vocabulary])
    return model.describeTopics(8).select("topic", F.transform("termIndices", lambda i: F.get(names, i)).alias("words"))


# --- folds and splits ---------------------------------------------------------------


@query("k_fold", "WITH x AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, (CASE WHEN r < (n % 7) * (n // 7 + 1) THEN r // (n // 7 + 1) ELSE (r - (n % 7) * (n // 7 + 1)) // (n // 7) + n % 7 END)::INT AS fold FROM x")
def k_fold(spark: SparkSession, d: str) -> DataFrame:
    return folds.k_fold(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@query("hold_out", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 < floor(count(*) OVER () * 0.1) AS is_valid FROM customer")
def hold_out(spark: SparkSession, d: str) -> DataFrame:
    return folds.hold_out(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], 0.1)


@query("stratified_sizes", "SELECT o_orderpriority, floor(count(*) * 0.25)::BIGINT AS test_rows, count(*) AS rows FROM orders GROUP BY 1")
def stratified_sizes(spark: SparkSession, d: str) -> DataFrame:
    x = folds.stratified_hold_out(table(spark, d, "orders"), "o_orderpriority", [F.col("o_orderkey")], 0.25)
    return x.groupBy("o_orderpriority").agg(F.count_if("is_test").alias("test_rows"), F.count(F.lit(1)).alias("rows"))


@query("random_halves", "SELECT 0 AS cluster, count(*) // 2 AS n FROM orders UNION ALL SELECT 1, count(*) - count(*) // 2 FROM orders")
def random_halves(spark: SparkSession, d: str) -> DataFrame:
    return folds.balanced_halves(table(spark, d, "orders"), [F.col("o_orderkey")]).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("hyperplane_split", "SELECT o_orderkey, ((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) * 0.6 + (o_custkey - (SELECT avg(o_custkey) FROM orders)) * -0.8 > 0)::INT AS cluster FROM orders")
def hyperplane_split(spark: SparkSession, d: str) -> DataFrame:
    return rowsplits.hyperplane(table(spark, d, "orders"), ["o_totalprice", "o_custkey"], [0.6, -0.8]).select("o_orderkey", "cluster")


@query("condition_split", "SELECT event_type, count_if(value <= 50) AS low FROM events GROUP BY 1")
def condition_split(spark: SparkSession, d: str) -> DataFrame:
    return rowsplits.condition(table(spark, d, "events"), "value", 50.0, "continuous").groupBy("event_type").agg(F.sum("cluster").alias("low"))


def _glass(spark: SparkSession, d: str) -> DataFrame:
    spec = features_of(table(spark, d, "feature_domain"), "glass")
    x = table(spark, d, "glass").select("record_id", *[known(F.col(c), spec[c]).alias(c) for c in ("ri", "na2o", "mgo", "al2o3", "glass_type")])
    return x.dropDuplicates(["record_id"])


@query("kmeans_split")
def kmeans_split(spark: SparkSession, d: str) -> DataFrame:
    x = rowsplits.kmeans(_glass(spark, d), ["na2o", "mgo", "al2o3"], 3)
    return x.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), r(F.avg("mgo"), 4).alias("mean_mgo"))


@query("rdc_kmeans_split")
def rdc_kmeans_split(spark: SparkSession, d: str) -> DataFrame:
    return rowsplits.rdc_kmeans(_glass(spark, d).dropna(), ["na2o", "mgo", "al2o3"], 2).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("density_split")
def density_split(spark: SparkSession, d: str) -> DataFrame:
    return rowsplits.dbscan(_glass(spark, d), "record_id", ["na2o", "mgo"], 0.08, 10).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


# --- dependence and graphs ----------------------------------------------------------


@query("sine_features", "SELECT c_custkey, round(sin(u * 3.5 + 0.25), 8) AS f0, round(sin(u * -1.25 + 1.5), 8) AS f1 FROM (SELECT c_custkey, cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS u FROM customer)")
def sine_features(spark: SparkSession, d: str) -> DataFrame:
    x = ordered.ecdf(table(spark, d, "customer"), "c_acctbal", "u", ["c_nationkey"])
    a, b = S.sine_features(F.col("u"), [3.5, -1.25], [0.25, 1.5])
    return x.select("c_custkey", r(a, 8).alias("f0"), r(b, 8).alias("f1"))


@query("dependence_one_feature", "SELECT round(abs(corr(sin(u * 2.0), sin(v * 2.0))), 7) AS rdc FROM (SELECT cume_dist() OVER (ORDER BY l_quantity) AS u, cume_dist() OVER (ORDER BY l_extendedprice) AS v FROM lineitem)")
def dependence_one_feature(spark: SparkSession, d: str) -> DataFrame:
    x = ordered.ecdf(ordered.ecdf(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "u"), "l_extendedprice", "v")
    return x.agg(r(F.abs(F.corr(F.sin(F.col("u") * 2.0), F.sin(F.col("v") * 2.0))), 7).alias("rdc"))


@query("dependence_matrix")
def dependence_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Randomised dependence coefficients of line item columns, and the component of each at 0.3."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    m = dependence.rdc(table(spark, d, "lineitem"), cols)
    part = graphs.above(m, 0.3)
    return spark.createDataFrame([(a, b, round(float(m[i, j]), 6), part[i] == part[j]) for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j], "a string, b string, rdc double, same_component boolean")


@query("connected_components", "WITH RECURSIVE e AS (SELECT DISTINCT p_brand || '/' || p_size % 3 AS a, p_type AS b FROM part), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.node) SELECT node, min(c) AS component FROM r GROUP BY 1")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.concat_ws("/", "p_brand", F.col("p_size") % 3).alias("a"), F.col("p_type").alias("b"))
    return graphs.connected(p.distinct())


_KINDS = "(SELECT unnest(['continuous', 'discrete', 'categorical']) AS k, generate_subscripts([1, 2, 3], 1) - 1 AS i)"
_STATES = "(SELECT unnest([0, 1, 2])::INT AS l)"


@query(
    "dependency_graphs",
    f"SELECT (a.i * 243 + b.i * 81 + c.i * 27 + x.l * 9 + y.l * 3 + z.l)::BIGINT AS graph, a.k || ',' || b.k || ',' || c.k AS types, x.l || ',' || y.l || ',' || z.l AS links FROM {_KINDS} a, {_KINDS} b, {_KINDS} c, {_STATES} x, {_STATES} y, {_STATES} z",
)
def dependency_graphs(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, ",".join(g["types"]), ",".join(map(str, g["links"]))) for i, g in enumerate(graphs.dependency_graphs())], "graph long, types string, links string")


# --- distances ------------------------------------------------------------------------


@query("nearest_embedding", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id AS query, arg_min(b.vec_id, list_distance(a.v, b.v)) AS nearest FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY 1")
def nearest_embedding(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return distances.nearest(e.where(F.col("vec_id") % 20 == 0), e, "vec_id", "embedding").select("query", "nearest")


@query("gower_to_medoid", "WITH m AS (SELECT c_nationkey AS k, arg_min(c_acctbal, c_custkey) AS b, arg_min(c_mktsegment, c_custkey) AS s FROM customer GROUP BY 1) SELECT c_custkey, round((abs(c_acctbal - b) / 11000 + (c_mktsegment <> s)::INT) / 2, 7) AS d FROM customer JOIN m ON k = c_nationkey")
def gower_to_medoid(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    m = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.min_by("c_acctbal", "c_custkey").alias("b"), F.min_by("c_mktsegment", "c_custkey").alias("s"))
    x = c.join(F.broadcast(m), F.col("k") == F.col("c_nationkey"))  # a row per nation
    return x.select("c_custkey", r(distances.gower([F.col("c_acctbal"), F.col("c_mktsegment")], [F.col("b"), F.col("s")], ["continuous", "categorical"], [11000.0, 1.0]), 7).alias("d"))


VECTORS = {"rows": (1.0, 0.0), "table": (0.0, 1.0), "fold": (1.0, 1.0), "samples": (2.0, 0.5), "split": (0.5, 2.0)}


@query("relaxed_transport", "WITH v(word, x, y) AS (VALUES " + ", ".join(f"('{w}', {x}, {y})" for w, (x, y) in VECTORS.items()) + f"), b AS (SELECT doc_id, x, y, sqrt((x - 1) * (x - 1) + y * y) AS c0, sqrt(x * x + (y - 1) * (y - 1)) AS c1 FROM ({WORDS}) JOIN v ON token = word), m AS (SELECT doc_id, greatest(avg(least(c0, c1)), 0.5 * min(c0) + 0.5 * min(c1)) AS d FROM b GROUP BY 1) SELECT doc_id, round(d, 7) AS d FROM m")
def relaxed_transport(spark: SparkSession, d: str) -> DataFrame:
    bags = _tokens(spark, d).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    out = distances.relaxed_transport(bags, "doc_id", "token", "n", {k: list(v) for k, v in VECTORS.items()}, {"rows": 1.0, "table": 1.0})
    return out.where(F.col("d") != float("inf")).select("doc_id", r("d", 7).alias("d"))


@query("word_movers")
def word_movers(spark: SparkSession, d: str) -> DataFrame:
    """Exact word mover's distance of every bag of the five words to the mean bag."""
    words = list(VECTORS)
    bag = lambda cols: F.filter(F.array(*[F.struct(c.cast("double").alias("weight"), F.array(*[F.lit(v) for v in VECTORS[w]]).alias("vector")) for c, w in zip(cols, words)]), lambda s: s["weight"] > 0)
    counts = _tokens(spark, d).where(F.col("token").isin(*words)).groupBy("doc_id").pivot("token", words).count().na.fill(0)
    pairs = counts.select("doc_id", bag([F.col(w) for w in words]).alias("a"), bag([F.lit(1.0)] * len(words)).alias("b"))
    return distances.word_movers(pairs, "a", "b", "d").select("doc_id", r("d").alias("d"))


# --- scalar functions and schema files ----------------------------------------------------


@query("string_functions", "SELECT event_id, hour(ts) AS hour, replace(event_type, 'c', 'k') AS translated, json_extract_string(props, '$.k') AS k, round(sign(value - 50) * ln(1 + abs(value - 50)), 7) AS signed_log FROM events")
def string_functions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", S.epoch_hour(F.unix_timestamp("ts")).alias("hour"), F.translate("event_type", "c", "k").alias("translated"), F.get_json_object("props", "$.k").alias("k"), r(S.signed_log(F.col("value") - 50), 7).alias("signed_log"))


@query("bit_codes", "SELECT l_orderkey, (pow(2, (l_linenumber > 3)::INT) + pow(2, (l_quantity > 25)::INT))::BIGINT AS code FROM lineitem")
def bit_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", S.bit_power_sum([(F.col("l_linenumber") > 3).cast("int"), (F.col("l_quantity") > 25).cast("int")]).alias("code"))


@query("barycentric", "WITH s AS (SELECT l_orderkey, l_quantity / (l_quantity + 10 + l_linenumber) AS a, 10.0 / (l_quantity + 10 + l_linenumber) AS b, l_linenumber / (l_quantity + 10 + l_linenumber) AS c FROM lineitem) SELECT l_orderkey, round(-b * sqrt(3) / 2 + c * sqrt(3) / 2, 7) AS x, round(a - b / 2 - c / 2, 7) AS y FROM s")
def barycentric(spark: SparkSession, d: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    t = q + 10 + n
    x, y = S.to_cartesian([q / t, 10.0 / t, n / t])
    return table(spark, d, "lineitem").select("l_orderkey", r(x, 7).alias("x"), r(y, 7).alias("y"))


@query("equation", "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS v FROM lineitem")
def equation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", r(S.equation("l_extendedprice * (1 - l_discount) * (1 + l_tax)"), 6).alias("v"))


@query("interpolation", "SELECT c_custkey, round(CASE WHEN c_acctbal <= 0 THEN 1 WHEN c_acctbal < 5000 THEN 1 + c_acctbal * 3 / 5000 WHEN c_acctbal < 8000 THEN 4 - (c_acctbal - 5000) * 2 / 3000 ELSE 2 END, 7) AS y FROM customer")
def interpolation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", r(S.interpolate(F.col("c_acctbal"), [0, 5000, 8000], [1, 4, 2]), 7).alias("y"))


@query("schema_lines", "SELECT table_name, field_name || ':' || feature_type || CASE WHEN domain_codes IS NOT NULL THEN ':' || array_to_string(domain_codes, ',') WHEN feature_type = 'continuous' THEN ':' || printf('%.5f,%.5f', domain_lo, domain_hi) ELSE ':' || domain_lo::INT || ',' || domain_hi::INT END || '.' AS line FROM feature_domain")
def schema_lines(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for x in table(spark, d, "feature_domain").collect():  # a schema
        domain = tuple(map(float, x["domain_codes"])) if x["domain_codes"] else (x["domain_lo"], x["domain_hi"])
        out.append((x["table_name"], FF.format_line(FF.Column_(x["field_name"], x["feature_type"], domain))))
    return spark.createDataFrame(out, "table_name string, line string")


@query("nation_kinds", "SELECT column_name, CASE WHEN column_type IN ('INTEGER', 'BIGINT') THEN 'discrete' WHEN column_type = 'DOUBLE' THEN 'continuous' ELSE 'categorical' END AS kind FROM (DESCRIBE supplier)")
def nation_kinds(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(loaders.infer_kinds(table(spark, d, "supplier")).items()), "column_name string, kind string")


@query("label_codes", "SELECT DISTINCT p_brand AS value, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
def label_codes(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy("value")
    return table(spark, d, "part").select(F.col("p_brand").alias("value")).distinct().withColumn("code", (F.row_number().over(w) - 1).cast("long"))  # a vocabulary
