"""Scoring streams: the same expression as for tables, so append mode works unchanged; and windows over the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probloom.model.nodes import Node
from probloom.model.score import expression


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def score_stream(stream: DataFrame, model: Node, columns: list[str], out: str = "ll") -> DataFrame:
    """Append the log-likelihood of every row; stateless."""
    return stream.withColumn(out, expression(model, columns))


def unlikely_windows(scored: DataFrame, time: str, ll: str, below: float, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per window: rows, mean log-likelihood and rows below a bound; rows later than the watermark are left out."""
    w = scored.withWatermark(time, late).groupBy(F.window(time, width))
    return w.agg(F.count(F.lit(1)).alias("rows"), F.avg(ll).alias("mean_ll"), F.count_if(F.col(ll) < below).alias("unlikely")).select(F.col("window.start").alias("start"), "rows", "mean_ll", "unlikely")
