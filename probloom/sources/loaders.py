"""Readers and writers of data files as DataFrames. None of them infers a schema from the data unless it says so."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probloom.operators.transforms import gray
from probloom.runtime import salted_rank
from probloom.sources import features_file as S

SPLITS = ("train", "valid", "test")


def load_splits(spark: SparkSession, name: str, folder: str) -> tuple[DataFrame, list[S.Column_]]:
    """``<name>.{train,valid,test}.data`` beside ``<name>.features`` as one table with a ``split`` column."""
    columns = S.read(spark, f"{folder}/{name}.features")
    schema = S.schema_of(columns)
    parts = [spark.read.schema(schema).csv(f"{folder}/{name}.{s}.data").withColumn("split", F.lit(s)) for s in SPLITS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]), columns


def save_splits(df: DataFrame, columns: Sequence[S.Column_], path: str) -> None:
    """Data files in the plain format, a folder per split."""
    df.select(*S.output_formats(df, columns), "split").write.mode("overwrite").partitionBy("split").csv(path)


def save_named(df: DataFrame, columns: Sequence[S.Column_], name: str, folder: str) -> None:
    """The files that ``load_splits`` reads: the schema, and a data file (a folder of parts) per split."""
    lines = S.format_columns(columns).splitlines()
    df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(f"{folder}/{name}.features")  # a line per column
    for s in SPLITS:
        df.where(F.col("split") == s).select(*S.output_formats(df, columns)).write.mode("overwrite").csv(f"{folder}/{name}.{s}.data")


def save_folds(df: DataFrame, path: str, by: Sequence[str] = ("fold", "split")) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def load_folds(spark: SparkSession, path: str, fold: int | None = None, split: str | None = None, labels: Sequence[str] = (), part: str = "all") -> DataFrame:
    """Saved folds; ``part``: all columns, features (x) alone or labels (y) alone. Folds and splits are pruned by folder."""
    df = spark.read.parquet(path)
    df = df.where(F.col("fold") == fold) if fold is not None else df
    df = df.where(F.col("split") == split) if split is not None else df
    return df.drop(*labels) if part == "x" else df.select(*labels) if part == "y" else df


def tokenised(spark: SparkSession, path: str, sep: str = ",", header: bool = False) -> DataFrame:
    """(line_no, tokens) of a text file: a full stop at the end removed, tokens trimmed; blank lines left out."""
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no"))
    lines = raw.where(F.trim("value") != "")
    if header:
        first = lines.agg(F.min("line_no").alias("m"))
        lines = lines.join(F.broadcast(first), F.col("line_no") > F.col("m")).drop("m")  # one row
    return lines.select("line_no", F.transform(F.split(F.regexp_replace("value", r"\.\s*$", ""), re.escape(sep)), lambda x: F.trim(x)).alias("tokens"))


def without_missing(spark: SparkSession, path: str, mark: str = "?", header: bool = False, last: bool = False, save: str | None = None) -> DataFrame:
    """Lines without blank ones and without any that holds the mark before a comma (``last``: or at its end); the first may be a header, which goes.

    ``save``: a folder that the lines are written to as text.
    """
    v = F.trim("value")
    raw = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    if header:
        raw = raw.join(F.broadcast(raw.agg(F.min("line_no").alias("m"))), F.col("line_no") > F.col("m"))  # one row
    out = raw.where((v != "") & ~v.contains(f"{mark},") & (~v.endswith(mark) if last else F.lit(True))).select("value")
    if save:
        out.write.mode("overwrite").text(save)
    return out


def encoded(tokens: DataFrame, columns: Sequence[S.Column_], codes: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Typed columns from token arrays; values without a code become NULL."""
    out = []
    for i, c in enumerate(columns):
        raw = F.get("tokens", F.lit(i))
        if c.name in codes and codes[c.name]:
            pairs = F.create_map(*[x for k, v in codes[c.name].items() for x in (F.lit(k), F.lit(float(v)))])
            out.append(F.try_element_at(pairs, raw).alias(c.name))
        else:
            out.append(F.expr(f"try_cast(get(tokens, {i}) AS DOUBLE)").alias(c.name))
    return tokens.select("line_no", *out)


def label_codes(df: DataFrame, column: str, most: int = 10_000) -> dict[str, int]:
    """Codes of the sorted distinct values of a column."""
    got = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"{column} has more than {most} values")
    return {v: i for i, v in enumerate(sorted(got))}


def infer_kinds(df: DataFrame, override: Mapping[str, str] | None = None) -> dict[str, str]:
    """Feature type of every column by its data type: whole numbers discrete, other numbers continuous, the rest categorical."""
    out = {}
    for f in df.schema:
        whole = isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        out[f.name] = "discrete" if whole else "continuous" if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)) else "categorical"
    return out | dict(override or {})


def adult(spark: SparkSession, path: str, schema: str, override: Mapping[str, str] | None = None) -> tuple[DataFrame, dict[str, str], dict[str, dict[str, int]]]:
    """A census-like CSV: trimmed, rows with a ``?`` dropped, types inferred from the schema, text coded by sorted value."""
    df = spark.read.schema(schema).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("nullValue", "?").csv(path).dropna()
    kinds = infer_kinds(df, override)
    codes = {f.name: label_codes(df, f.name) for f in df.schema if isinstance(f.dataType, T.StringType)}
    for c, m in codes.items():
        pairs = F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(float(v)))]) if m else F.create_map()
        df = df.withColumn(c, F.element_at(pairs, F.col(c)) if m else F.lit(None).cast("double"))
    return df, kinds, codes


def plain_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, header: bool = True) -> DataFrame:
    """Numeric CSV; all columns double. Names from the header line, which is read alone, or given."""
    if columns is None:
        first = spark.read.text(path).limit(1).collect()
        columns = [c.strip().strip('"') for c in first[0]["value"].split(",")] if first else []
    return spark.read.schema(T.StructType([T.StructField(c, T.DoubleType()) for c in columns])).option("header", header).csv(path)


def class_first(df: DataFrame, label: str, drop: Sequence[str] = ()) -> DataFrame:
    """The class as first column, identifiers dropped."""
    return df.select(label, *[c for c in df.columns if c != label and c not in drop])


def traffic(spark: SparkSession, path: str, columns: Sequence[str], time: str) -> DataFrame:
    """A ``;`` CSV with ``NA`` for missing: rows with any dropped, the epoch column turned to an hour."""
    df = spark.read.schema(T.StructType([T.StructField(c, T.DoubleType()) for c in columns])).option("sep", ";").option("header", True).option("nullValue", "NA").csv(path)
    return df.dropna().withColumn(time, F.hour(F.timestamp_seconds(F.col(time).cast("long"))).cast("double"))


def sparse_counts(spark: SparkSession, path: str) -> DataFrame:
    """(doc, word, count) of lines ``id,word,count,word,count,..``; kept long."""
    parts = F.split("value", ",")
    pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 3) / 2).cast("int")), lambda i: F.struct(F.get(parts, (i * 2 + 1).cast("int")).alias("word"), F.get(parts, (i * 2 + 2).cast("int")).cast("long").alias("count")))
    return spark.read.text(path).where(F.size(parts) >= 3).select(F.get(parts, F.lit(0)).alias("doc"), F.explode(pairs).alias("p")).select("doc", "p.word", "p.count")


def dense_counts(long: DataFrame, doc: str, word: str, count: str, words: Sequence[str]) -> DataFrame:
    """A column per word of a given vocabulary."""
    return long.groupBy(doc).pivot(word, list(words)).sum(count).na.fill(0)


def attribute_table(spark: SparkSession, names_path: str, data_path: str) -> DataFrame:
    """Numeric attributes of an ``@attribute`` file with its CSV; rows with ``?`` in one of them dropped."""
    declared = [m.groups() for r in spark.read.text(names_path).collect() if (m := re.match(r"@attribute\s+(\S+)\s+(\S+)", r["value"].strip(), re.I))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n, _ in declared])
    numeric = [n for n, t in declared if t.lower() in ("numeric", "real", "integer")]
    df = spark.read.schema(schema).option("ignoreLeadingWhiteSpace", True).option("comment", "@").csv(data_path)
    return df.select(*[F.expr(f"try_cast(`{n}` AS DOUBLE)").alias(n) for n in numeric]).dropna()


def item_sequences(lines: DataFrame, text: str = "value") -> DataFrame:
    """(seq_no, set_no, item, n) of sequences where -1 ends an item set and -2 a sequence."""
    seqs = lines.select(F.monotonically_increasing_id().alias("line"), F.posexplode(F.split(text, r"(^|\s)-2(\s|$)")).alias("s", "seq"))
    sets = seqs.where(F.trim("seq") != "").select("line", "s", F.posexplode(F.split("seq", r"(^|\s)-1(\s|$)")).alias("set_no", "items"))
    items = sets.select("line", "s", "set_no", F.explode(F.split(F.trim("items"), r"\s+")).alias("item")).where("item <> ''")
    return items.groupBy("line", "s", "set_no", "item").agg(F.count(F.lit(1)).alias("n")).select(F.struct("line", "s").alias("seq_no"), "set_no", "item", "n")


def reviews(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """(line, token, count, label, domain) of lines ``token:count .. #label#:value``."""
    base = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("t"))
    label = F.regexp_replace(F.get(F.filter("t", lambda x: x.startswith("#label#")), F.lit(0)), "^#label#:", "")
    pairs = base.select("line", label.alias("label"), F.explode(F.filter("t", lambda x: ~x.startswith("#label#") & x.contains(":"))).alias("p"))
    return pairs.select("line", F.substring_index("p", ":", 1).alias("token"), F.substring_index("p", ":", -1).cast("long").alias("count"), "label", F.lit(domain).alias("domain"))


def image_batches(parts: Sequence[DataFrame], pixels: str) -> DataFrame:
    """Batches under one another, with gray values."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("gray", gray(F.col(pixels)))


def with_labels(embedding: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """A learned representation beside its labels, by row key."""
    return embedding.join(labels, key)


def halves(df: DataFrame, key: Sequence[Column], share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Two parts of a table in a fixed pseudo-random order."""
    n = df.count()
    ranked = salted_rank(df, [], list(key), "__r")
    cut = int(n * share)
    return ranked.where(F.col("__r") < cut).drop("__r"), ranked.where(F.col("__r") >= cut).drop("__r")


def word_bags(documents: DataFrame, key: str, text: str, vectors: DataFrame, stop: Sequence[str] = ()) -> DataFrame:
    """(key, word, n, v) of the words that have a vector."""
    from probloom.functions.scalar import words

    long = documents.select(key, F.explode(words(F.col(text), stop)).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    return long.join(vectors, "word")


# --- results -------------------------------------------------------------------


def append_results(df: DataFrame, path: str) -> None:
    """Rows of experiments, added to a Parquet table."""
    df.write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str, not_run: Sequence[str] = ()) -> DataFrame:
    """Results, without runs whose numbers are all 0."""
    df = spark.read.parquet(path)
    if not_run:
        total = F.lit(0.0)
        for c in not_run:
            total = total + F.abs(F.col(c))
        df = df.where(total > 0)
    return df


def write_log(df: DataFrame, path: str) -> None:
    """An experiment log (a row per run, hence small: one file) as tab-separated text with a header, the mean over runs as last row."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    mean = df.agg(*[F.avg(c).alias(c) for c in numbers]).select(*[F.col(c).cast("string") if c in numbers else F.lit("mean").alias(c) for c in df.columns])
    rows = df.select(*[F.col(c).cast("string") for c in df.columns]).withColumn("__o", F.lit(0)).unionByName(mean.withColumn("__o", F.lit(1)))
    rows.coalesce(1).sortWithinPartitions("__o").drop("__o").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_scores(df: DataFrame, path: str) -> None:
    """Scored rows, a folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


class Stats:
    """Measure -> method -> values, kept as a long table; saved as JSON ``[name, values, settings]``."""

    def __init__(self, name: str, settings: dict | None = None) -> None:
        self.name, self.settings, self.values = name, settings or {}, {}

    def add(self, measure: str, method: str, value: float) -> None:
        self.values.setdefault(measure, {}).setdefault(method, []).append(float(value))

    def rows(self) -> list[tuple[str, str, str, int, float]]:
        return [(self.name, m, k, i, v) for m, by in self.values.items() for k, vs in by.items() for i, v in enumerate(vs)]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "name string, measure string, method string, fold int, value double")

    def to_json(self) -> str:
        return json.dumps([self.name, self.values, self.settings])

    @classmethod
    def from_json(cls, text: str) -> Stats:
        name, values, settings = json.loads(text)
        out = cls(name, settings)
        out.values = values
        return out
