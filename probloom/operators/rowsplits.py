"""Row splits of one table as columns: k-means, dependence features, density, hyperplane, condition, mode, halves."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from probloom.functions import scalar as S
from probloom.operators import dependence as D
from probloom.operators.graphs import connected
from probloom.runtime import stored


def kmeans(df: DataFrame, columns: Sequence[str], k: int = 2, seed: int = 17, out: str = "cluster") -> DataFrame:
    """Append the cluster of every row; rows with a NULL among the columns get none."""
    seen = VectorAssembler(inputCols=list(columns), outputCol="__in", handleInvalid="keep").transform(df.withColumn("__ok", S.add([F.col(c).isNull().cast("int") for c in columns]) == 0))
    model = KMeans(k=k, seed=seed, featuresCol="__in", predictionCol="__c").fit(seen.where("__ok"))
    given = df.columns
    scored = model.transform(seen.where("__ok")).select(*given, F.col("__c").alias(out))
    return scored.unionByName(df.where(~(S.add([F.col(c).isNull().cast("int") for c in columns]) == 0)).withColumn(out, F.lit(None).cast("int")))


def rdc_kmeans(df: DataFrame, columns: Sequence[str], k: int = 2, seed: int = 17, out: str = "cluster") -> DataFrame:
    """k-means on the sine features of the rank-transformed columns (ranks from 256 quantiles); rows with a NULL get none."""
    at = [(i + 1) / D.QUANTILES for i in range(D.QUANTILES)]
    grid = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 10_000).alias(c) for c in columns]).first()
    grids = [np.array(sorted(grid[c] or [0.0])) for c in columns]
    features = D.feature_count([1] * len(columns))
    made = [f"__f{i}" for i in range(features * len(columns))]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.hstack([D.nonlinear(np.asarray(b.column(i).to_numpy(zero_copy_only=False), float), grids[i], seed + i, features) for i in range(len(grids))])
            gone = np.isnan(np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(grids))], 1).astype(float)).any(1)
            yield pa.RecordBatch.from_arrays([*b.columns[len(grids) :], *[pa.array(v, mask=gone) for v in f.T]], [*b.schema.names[len(grids) :], *made])

    given = [f"__u{i}" for i in range(len(df.columns))]
    rows = df.select(*[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)], *[F.col(c).alias(u) for c, u in zip(df.columns, given)])
    shape = StructType([*rows.select(*given).schema.fields, *[StructField(m, DoubleType()) for m in made]])
    scored = kmeans(rows.mapInArrow(project, shape), made, k, seed, "__cluster")
    return scored.select(*[F.col(u).alias(c) for c, u in zip(df.columns, given)], F.col("__cluster").alias(out))


def dbscan(df: DataFrame, key: str, columns: Sequence[str], eps: float, least: int, out: str = "cluster") -> DataFrame:
    """(key, cluster) by density, exactly: the least core key of each cluster, -1 for noise.

    Rows fall in cells of side eps/sqrt(d), whose members are all neighbours: a
    cell with enough members makes all of them core without comparing pairs.
    Elsewhere neighbours are counted over the cells within reach, and core rows
    link cells, not rows. Border rows go to the cluster of the smallest id in reach.
    """
    d = len(columns)
    side = eps / math.sqrt(d)
    reach = math.ceil(math.sqrt(d))
    cs = [f"c{i}" for i in range(d)]
    rows = df.where(S.add([F.col(c).isNull().cast("int") for c in columns]) == 0).select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    rows = rows.select("*", *[F.floor(F.col(f"x{i}") / S.lit(side)).alias(f"c{i}") for i in range(d)])
    rows = stored(rows, "points")
    size = rows.groupBy(*cs).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(size, cs)

    def around(t: DataFrame) -> DataFrame:
        for i in range(d):
            t = t.withColumn(f"t{i}", F.explode(F.sequence(F.col(f"c{i}") - reach, F.col(f"c{i}") + reach)))
        return t

    gap = S.add([F.pow(F.col(f"a.x{i}") - F.col(f"b.x{i}"), F.lit(2)) for i in range(d)])
    on = [F.col(f"a.t{i}") == F.col(f"b.c{i}") for i in range(d)]
    cond = on[0]
    for o in on[1:]:
        cond = cond & o
    sparse = around(rows.where(F.col("n") < least)).alias("a").join(rows.alias("b"), cond & (gap <= eps * eps)).groupBy(F.col("a.key").alias("key")).agg(F.count(F.lit(1)).alias("near"))
    core = stored(rows.join(sparse.where(F.col("near") >= least).select("key"), "key", "left_semi").unionByName(rows.where(F.col("n") >= least)), "core")
    cell = core.groupBy(*cs).agg(F.min("key").alias("cell"))
    core = core.join(cell, cs)
    links = around(core).alias("a").join(core.alias("b"), cond & (F.col("a.cell") < F.col("b.cell")) & (gap <= eps * eps)).select(F.col("a.cell").alias("a"), F.col("b.cell").alias("b")).distinct()
    own = core.select(F.col("cell").alias("a"), F.col("cell").alias("b")).distinct()
    comp = connected(links.unionByName(own))
    core = stored(core.join(comp, F.col("cell") == F.col("node")).select("key", "component", *[f"x{i}" for i in range(d)], *cs), "core-labels")
    border = around(rows.join(core.select("key"), "key", "left_anti")).alias("a").join(core.alias("b"), cond & (gap <= eps * eps)).groupBy(F.col("a.key").alias("key")).agg(F.min("b.component").alias("component"))
    found = core.select("key", "component").unionByName(border)
    return rows.select("key").join(found, "key", "left").select(F.col("key").alias(key), F.coalesce("component", F.lit(-1)).alias(out))


def hyperplane(df: DataFrame, columns: Sequence[str], plane: Sequence[float], out: str = "cluster") -> DataFrame:
    """Side of a plane through the mean."""
    m = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.withColumn(out, S.hyperplane_side([F.col(c) for c in columns], [m[c] or 0.0 for c in columns], plane))


def condition(df: DataFrame, column: str, value: float, kind: str, out: str = "cluster") -> DataFrame:
    """1 where the column is at most the value (continuous) or equals it."""
    c = F.col(column)
    return df.withColumn(out, ((c <= value) if kind == "continuous" else (c == value)).cast("int"))
