"""Queries of the readers and writers of files: a table is written in a file format and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probloom.plans.catalog import query
from probloom.runtime import scratch_dir, table
from probloom.sources import features_file as FF
from probloom.sources import loaders as L


def r(c: Column | str, n: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def written(df: DataFrame, label: str) -> str:
    """One text column as a text file."""
    at = scratch_dir(df.sparkSession, label)
    df.write.text(at)
    return at


@query(
    "split_files",
    "SELECT CASE l_linenumber % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(round(l_tax, 5)), 2) AS tax, max(l_linenumber)::DOUBLE AS line FROM lineitem GROUP BY 1",
)
def split_files(spark: SparkSession, d: str) -> DataFrame:
    """Schema and data files of three splits, written and loaded."""
    columns = [FF.Column_("l_quantity", "discrete", tuple(map(float, range(1, 51)))), FF.Column_("l_tax", "continuous", (0.0, 0.1)), FF.Column_("l_linenumber", "categorical", tuple(map(float, range(1, 8))))]
    split = F.when(F.col("l_linenumber") % 3 == 0, "train").when(F.col("l_linenumber") % 3 == 1, "valid").otherwise("test")
    at = scratch_dir(spark, "split-files")
    L.save_named(table(spark, d, "lineitem").select(*[c.name for c in columns], split.alias("split")), columns, "items", at)
    got, read = L.load_splits(spark, "items", at)
    if read != columns:
        raise ValueError("the schema file doesn't give the columns back")
    return got.groupBy("split").agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity"), 2).alias("quantity"), r(F.sum("l_tax"), 2).alias("tax"), F.max("l_linenumber").alias("line"))


@query("fold_files", "SELECT (l_orderkey % 3)::INT AS fold, count(*) AS n, max(l_quantity) AS quantity FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1")
def fold_files(spark: SparkSession, d: str) -> DataFrame:
    """Folds saved by folder; one part of them read back."""
    at = scratch_dir(spark, "fold-files")
    x = table(spark, d, "lineitem").select("l_quantity", "l_linenumber", (F.col("l_orderkey") % 3).cast("int").alias("fold"), F.when(F.col("l_linenumber") % 2 == 0, "train").otherwise("test").alias("split"))
    L.save_folds(x, at)
    return L.load_folds(spark, at, split="train", labels=["l_linenumber"], part="x").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("quantity"))


@query("token_lines", "SELECT l_returnflag = 'R' AS returned, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def token_lines(spark: SparkSession, d: str) -> DataFrame:
    """Raw lines with missing marks: lines that hold one dropped, tokens trimmed and typed by a schema."""
    x = table(spark, d, "lineitem")
    line = F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" , "), F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("int").cast("string")).otherwise("?"), F.lit(", z."))
    kept = written(L.without_missing(spark, written(x.select(line.alias("value")), "raw-lines")), "kept-lines")
    columns = [FF.Column_("flag", "categorical"), FF.Column_("quantity", "discrete")]
    typed = L.encoded(L.tokenised(spark, kept), columns, {"flag": {"R": 1, "A": 0, "N": 0}})
    return typed.groupBy((F.col("flag") == 1).alias("returned")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("quantity"), 2).alias("quantity"))


@query("numeric_csv", "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS balance, sum(c_nationkey)::DOUBLE AS nations FROM customer")
def numeric_csv(spark: SparkSession, d: str) -> DataFrame:
    at = scratch_dir(spark, "numeric-csv")
    table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey").write.option("header", True).csv(at)
    got = L.class_first(L.plain_csv(spark, at), "c_nationkey", ["c_custkey"])
    return got.agg(F.count(F.lit(1)).alias("n"), r(F.sum("c_acctbal"), 2).alias("balance"), F.sum("c_nationkey").alias("nations"))


@query("typed_csv", "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS balance, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS code FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def typed_csv(spark: SparkSession, d: str) -> DataFrame:
    """A census-like file: rows with a missing mark dropped, text coded by sorted value."""
    at = scratch_dir(spark, "typed-csv")
    table(spark, d, "customer").select(F.concat(F.lit(" "), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")).otherwise("?")), F.concat(F.lit(" "), F.col("c_mktsegment"))).write.csv(at)
    got, kinds, codes = L.adult(spark, at, "balance double, segment string")
    names = F.create_map(*[x for k, v in codes["segment"].items() for x in (F.lit(float(v)), F.lit(k))])
    return got.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), r(F.avg("balance")).alias("balance")).select(F.element_at(names, F.col("segment")).alias("c_mktsegment"), "n", "balance", F.col("segment").alias("code"))


@query("hour_csv", "SELECT extract(hour FROM ts)::DOUBLE AS hour, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_type <> 'click' GROUP BY 1")
def hour_csv(spark: SparkSession, d: str) -> DataFrame:
    """A semicolon file with a time in epoch seconds: incomplete rows dropped, the time as hour."""
    at = scratch_dir(spark, "hour-csv")
    x = table(spark, d, "events")
    x.select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").alias("t"), F.when(F.col("event_type") == "click", "NA").otherwise(F.col("value").cast("string")).alias("v")).write.option("sep", ";").option("header", True).csv(at)
    return L.traffic(spark, at, ["t", "v"], "t").groupBy(F.col("t").alias("hour")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("v"), 2).alias("total"))


@query("sparse_lines", "SELECT l_returnflag AS word, sum(l_quantity)::BIGINT AS count, count(DISTINCT l_orderkey) AS docs FROM lineitem GROUP BY 1")
def sparse_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an id, words and counts, read long."""
    per = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").cast("long").alias("n"))
    lines = per.groupBy("l_orderkey").agg(F.concat_ws(",", F.flatten(F.collect_list(F.array("l_returnflag", F.col("n").cast("string"))))).alias("w"))  # three words at most
    got = L.sparse_counts(spark, written(lines.select(F.concat_ws(",", F.col("l_orderkey").cast("string"), "w").alias("value")), "sparse-lines"))
    return got.groupBy("word").agg(F.sum("count").alias("count"), F.countDistinct("doc").alias("docs"))


@query("sequence_lines", "SELECT event_type AS item, count(*) AS n FROM events GROUP BY 1")
def sequence_lines(spark: SparkSession, d: str) -> DataFrame:
    """Click streams: item sets ended by -1, a sequence by -2."""
    x = table(spark, d, "events").select(F.concat(F.col("event_type"), F.lit(" -1 -2")).alias("value"))
    return L.item_sequences(spark.read.text(written(x, "sequences"))).groupBy("item").agg(F.sum("n").alias("n"))


@query("review_lines", "SELECT l_linestatus AS label, l_returnflag AS token, sum(l_linenumber)::BIGINT AS count FROM lineitem GROUP BY 1, 2")
def review_lines(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.concat(F.col("l_returnflag"), F.lit(":"), F.col("l_linenumber").cast("string"), F.lit(" #label#:"), F.col("l_linestatus")).alias("value"))
    return L.reviews(spark, written(x, "reviews"), "shop").groupBy("label", "token").agg(F.sum("count").alias("count"))


@query("attribute_lines", "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_acctbal > 0")
def attribute_lines(spark: SparkSession, d: str) -> DataFrame:
    names = written(spark.createDataFrame([("@relation c",), ("@attribute segment string",), ("@attribute balance numeric",)], "value string").coalesce(1), "attributes")
    data = table(spark, d, "customer").select(F.concat("c_mktsegment", F.lit(", "), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")).otherwise("?")).alias("value"))
    return L.attribute_table(spark, names, written(data, "attribute-data")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("balance"), 2).alias("balance"))


@query("result_tables", "SELECT c_mktsegment AS run, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal <> 0 AND c_nationkey > 4 GROUP BY 1 UNION ALL SELECT 'mean', 1, round(avg(c_acctbal), 2) FROM customer")
def result_tables(spark: SparkSession, d: str) -> DataFrame:
    """Results appended in two parts and read without runs that are all 0; the mean row of a log."""
    at, log = scratch_dir(spark, "results"), scratch_dir(spark, "log")
    x = table(spark, d, "customer").select("c_mktsegment", F.when(F.col("c_nationkey") > 4, F.col("c_acctbal")).otherwise(F.lit(0.0)).alias("value"))
    L.append_results(x.where("value > 0"), at)
    L.append_results(x.where("value <= 0"), at)
    L.write_log(table(spark, d, "customer").select("c_name", "c_acctbal"), log)
    runs = L.read_results(spark, at, ["value"]).groupBy(F.col("c_mktsegment").alias("run")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2).alias("total"))
    last = spark.read.option("sep", "\t").option("header", True).csv(log).where("c_name = 'mean'")
    return runs.unionByName(last.select(F.lit("mean").alias("run"), F.lit(1).cast("long").alias("n"), r(F.col("c_acctbal").cast("double"), 2).alias("total")))


@query("score_files", "SELECT split, count(*) AS n, round(sum(ll), 4) AS ll FROM (SELECT CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS split, -value / 7 AS ll FROM events WHERE value IS NOT NULL) GROUP BY 1")
def score_files(spark: SparkSession, d: str) -> DataFrame:
    at = scratch_dir(spark, "scores")
    L.write_scores(table(spark, d, "events").where("value IS NOT NULL").select(F.when(F.col("value") > 50, "high").otherwise("low").alias("split"), (-F.col("value") / 7).alias("ll")), at)
    return L.read_results(spark, at).groupBy("split").agg(F.count(F.lit(1)).alias("n"), r(F.sum("ll")).alias("ll"))
