import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probloom.model.leaves import Gaussian
from probloom.schema import Feature, features_of, known, plain
from probloom.sources import features_file as FF
from probloom.sources import loaders as L
from probloom.streaming import scoring

TEXT = "len:continuous:4.3,7.9.\nn:discrete:1,2,3.\nclass:categorical:0,1,2.\nfree:continuous.\n"


def put(path, text):
    path.write_text(text)
    return str(path)


def test_schema_lines_round_trip(spark, tmp_path):
    cols = FF.read(spark, put(tmp_path / "a.features", TEXT))
    assert [c.kind for c in cols] == ["continuous", "discrete", "categorical", "continuous"] and cols[0].domain == (4.3, 7.9) and cols[3].domain is None
    assert FF.parse(FF.format_columns(cols)) == cols
    for bad in ("x:continuous", "x:odd:1.", "x."):
        with pytest.raises(ValueError):
            FF.parse_line(bad)
    meta = FF.schema_of(cols, ["gaussian"] * 4)["n"].metadata
    assert meta == {"feature_type": "discrete", "domain": [1.0, 2.0, 3.0], "family": "gaussian"}
    assert FF.coder(FF.Column_("x", "discrete"), ["1", "3", "many"]) == {"1": 1, "3": 3, "many": 4} and FF.coder(FF.Column_("x", "categorical"), ["b", "a", "b"]) == {"b": 0, "a": 1}
    assert FF.from_mappings(["x", "y"], ["categorical", "continuous"], [{"b": 1, "a": 0}, None])[0].domain == (0.0, 1.0)


def test_splits_and_folds(spark, tmp_path):
    put(tmp_path / "d.features", "a:continuous:0,9.\nc:categorical:0,1.\n")
    for s, t in (("train", "1.50000,0\n2.25000,1\n"), ("valid", "3.00000,1\n"), ("test", "4.00000,0\n")):
        put(tmp_path / f"d.{s}.data", t)
    df, cols = L.load_splits(spark, "d", str(tmp_path))
    assert df.count() == 4 and df.where("split = 'train'").agg(F.sum("a")).first()[0] == 3.75
    L.save_splits(df, cols, str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out/split=train")).collect()) == ["1.50000,0", "2.25000,1"]
    L.save_folds(df.withColumn("fold", F.lit(0)), str(tmp_path / "folds"))
    assert L.load_folds(spark, str(tmp_path / "folds"), 0, "test", ["c"], "y").columns == ["c"] and L.load_folds(spark, str(tmp_path / "folds"), split="train").count() == 2
    a, b = L.halves(df, [F.col("a")])
    assert a.count() == b.count() == 2
    assert L.class_first(df, "c", ["split"]).columns == ["c", "a"]


def test_text_loaders(spark, tmp_path):
    raw = put(tmp_path / "u.txt", "a , 1.\n\nb,?,2\nc,3\n")
    assert [r["tokens"] for r in L.tokenised(spark, raw).orderBy("line_no").collect()] == [["a", "1"], ["b", "?", "2"], ["c", "3"]]
    assert L.tokenised(spark, raw, header=True).count() == 2 and L.without_missing(spark, raw).count() == 2
    cols = [FF.Column_("k", "categorical"), FF.Column_("v", "continuous")]
    enc = L.encoded(L.tokenised(spark, raw), cols, {"k": {"a": 0, "c": 1}}).orderBy("line_no").collect()
    assert [(r["k"], r["v"]) for r in enc] == [(0.0, 1.0), (None, None), (1.0, 3.0)]
    df, kinds, codes = L.adult(spark, put(tmp_path / "ad.csv", "39, Private, 1.5\n40, ?, 2.5\n41, Gov, 3.5\n"), "age int, work string, hours double", {"age": "continuous"})
    assert df.count() == 2 and kinds == {"age": "continuous", "work": "categorical", "hours": "continuous"} and codes["work"] == {"Gov": 0, "Private": 1}
    assert L.plain_csv(spark, put(tmp_path / "p.csv", 'a,"b"\n1,2\n')).columns == ["a", "b"]
    t = L.traffic(spark, put(tmp_path / "t.csv", "t;x\n7200;1\n90000;NA\n"), ["t", "x"], "t").collect()
    assert [(r["t"], r["x"]) for r in t] == [(2.0, 1.0)]
    long = L.sparse_counts(spark, put(tmp_path / "g.csv", "7,cat,2,dog,1\n8,dog,4\n"))
    assert {tuple(r) for r in long.collect()} == {("7", "cat", 2), ("7", "dog", 1), ("8", "dog", 4)}
    assert L.dense_counts(long, "doc", "word", "count", ["cat", "dog"]).where("doc = '8'").first()["cat"] == 0
    names, data = put(tmp_path / "n.arff", "@attribute a numeric\n@attribute s string\n@attribute b real\n"), put(tmp_path / "n.csv", "1,x,2\n?,y,3\n")
    assert [tuple(r) for r in L.attribute_table(spark, names, data).collect()] == [(1.0, 2.0)]
    items = L.item_sequences(spark.createDataFrame([("1 2 2 -1 3 -1 -2",)], "value string"))
    assert {(r["set_no"], r["item"], r["n"]) for r in items.collect()} == {(0, "1", 1), (0, "2", 2), (1, "3", 1)}
    rev = L.reviews(spark, put(tmp_path / "r.txt", "good:2 bad:1 #label#:positive\n"), "books").collect()
    assert {(r["token"], r["count"], r["label"], r["domain"]) for r in rev} == {("good", 2, "positive", "books"), ("bad", 1, "positive", "books")}
    vec = spark.createDataFrame([("cat", [1.0])], "word string, v array<double>")
    bag = L.word_bags(spark.createDataFrame([(1, "The cat. Cat!")], "k int, t string"), "k", "t", vec, ["the"]).first()
    assert bag["n"] == 2


def test_result_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "run string, ll double")
    L.append_results(df, str(tmp_path / "res"))
    L.append_results(df, str(tmp_path / "res"))
    assert L.read_results(spark, str(tmp_path / "res")).count() == 4 and L.read_results(spark, str(tmp_path / "res"), ["ll"]).count() == 2
    L.write_log(df, str(tmp_path / "log"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert lines == ["run\tll", "a\t1.0", "b\t0.0", "mean\t0.5"]
    L.write_scores(df.withColumn("split", F.lit("test")), str(tmp_path / "ll"))
    assert spark.read.parquet(str(tmp_path / "ll")).count() == 2
    s = L.Stats("x", {"k": 1})
    s.add("ll", "spn", 1.5)
    s.add("ll", "spn", 2.5)
    again = L.Stats.from_json(s.to_json())
    assert json.loads(s.to_json())[2] == {"k": 1} and again.table(spark).where("fold = 1").first()["value"] == 2.5
    img = spark.createDataFrame([([1, 2, 3],)], "p array<int>")
    assert L.image_batches([img, img], "p").count() == 2
    assert L.with_labels(df, df.withColumnRenamed("ll", "y"), "run").count() == 2


def test_missing_values_and_plain_text(spark):
    f, c = Feature("x", "continuous", 0, 5), Feature("c", "categorical", codes=(0, 1))
    df = spark.createDataFrame([(1.0, 0), (float("nan"), 2), (6.0, None), (None, 1), (5.0, -1)], "x double, c int")
    assert [tuple(r) for r in df.select(known(F.col("x"), f), known(F.col("c"), c)).collect()] == [(1.0, 0.0), (None, None), (None, None), (None, 1.0), (5.0, None)]
    assert spark.range(1).select(plain(F.lit("　 A\t b "))).first()[0] == "a b"
    dom = spark.createDataFrame([("t", "x", "continuous", 0.0, 5.0, None, 0.1, None)], "table_name string, field_name string, feature_type string, domain_lo double, domain_hi double, domain_codes array<int>, overlap_tolerance double, cluster_step double")
    assert features_of(dom, "t")["x"] == Feature("x", "continuous", 0.0, 5.0, (), 0.1, None)
    with pytest.raises(ValueError):
        Feature("x", "odd")


def test_stream_scores_equal_table_scores(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "id long, v double").withColumn("ts", F.timestamp_seconds(F.col("id") * 60))
    df.write.parquet(str(tmp_path / "in"))
    model = Gaussian(0, 50.0, 10.0)
    stream = scoring.score_stream(scoring.read_stream(spark, str(tmp_path / "in"), df.schema), model, ["v"])
    q = stream.writeStream.format("memory").queryName("scored_rows").trigger(availableNow=True).start()
    q.awaitTermination()
    want = dict(df.select("id", model.column(F.col("v")).alias("ll")).collect())
    assert {r["id"]: r["ll"] for r in spark.table("scored_rows").collect()} == want
    w = scoring.unlikely_windows(stream, "ts", "ll", -5.0).writeStream.outputMode("complete").format("memory").queryName("scored_windows").trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.table("scored_windows").agg(F.sum("rows")).first()[0] == 100
    assert isinstance(df.schema, T.StructType)
