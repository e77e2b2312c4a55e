"""Ranks, running sums and neighbours in an order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probloom.runtime import stored


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with the number of their range; equal keys share a range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranged")


def running_sums(df: DataFrame, order: list[str], values: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Running sums ``values`` (out: column) in ``order`` (total within a group), of whole groups of any size.

    Rows are range-partitioned by group and order; each range of a group is
    summed on its own and shifted by the sums of its ranges before.
    """
    by = by or []
    rows = _ranged(df, [*by, *order])
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "__part").agg(*[F.sum(v).alias(f"__s_{o}") for o, v in values.items()])
    sums = sums.select(*by, "__part", *[F.coalesce(F.sum(f"__s_{o}").over(before), F.lit(0)).alias(f"__b_{o}") for o in values])  # a row per group and range
    inner = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__in_{o}": F.sum(v).over(inner) for o, v in values.items()})
    if by:  # as many rows as groups and ranges
        rows = rows.alias("r").join(sums.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__part").alias("__p"), *[f"__b_{o}" for o in values]).alias("s"), [F.col(f"r.{c}").eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)] + [F.col("__part") == F.col("__p")])
    else:  # a row per range
        rows = rows.join(F.broadcast(sums), "__part")
    return rows.select(*df.columns, *[(F.col(f"__in_{o}") + F.col(f"__b_{o}")).alias(o) for o in values])


def running_sum(df: DataFrame, order: list[str], value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Running sum in ``order`` (which must be total), per group or over the whole table."""
    return running_sums(df, order, {out: value}, by)


def ecdf(df: DataFrame, column: str, out: str = "ecdf", by: list[str] | None = None) -> DataFrame:
    """Share of values not above this one, in each group or all rows (ties take the greatest rank); NULLs have none and don't count.

    Rows are counted by value first, so a value that many rows share is one row
    of the running sum, and the shares are joined back to the rows.
    """
    by = by or []
    rows = df.where(F.col(column).isNotNull())
    key = [f"__k{i}" for i in range(len(by))]
    counts = rows.groupBy(*[F.col(c).alias(k) for c, k in zip(by, key)], F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    sums = running_sums(counts, ["__v"], {"__below": "__n"}, key)
    total = sums.groupBy(*key).agg(F.max("__below").alias("__all"))
    if key:
        sums = sums.alias("s").join(total.select(*[F.col(k).alias(f"__t{k}") for k in key], "__all"), [F.col(f"s.{k}").eqNullSafe(F.col(f"__t{k}")) for k in key]).drop(*[f"__t{k}" for k in key])
    else:
        sums = sums.crossJoin(F.broadcast(total))  # one row
    on = [F.col(column) == F.col("__v")] + [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, key)]
    return rows.join(sums, on).select(*df.columns, (F.col("__below") / F.col("__all")).alias(out))


def pairs_in_order(df: DataFrame, order: list[str], columns: list[str], by: list[str]) -> DataFrame:
    """Each row with the columns of the next one as ``next_<c>``; the last of a group has none."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).withColumn("__more", F.lead(F.lit(1)).over(w)).where("__more = 1").drop("__more")


def local_minima(df: DataFrame, order: list[str], value: str, by: list[str]) -> DataFrame:
    """Rows whose value is below both neighbours; ends are never minima."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__a", F.lag(value).over(w)).withColumn("__b", F.lead(value).over(w)).where((F.col(value) < F.col("__a")) & (F.col(value) < F.col("__b"))).drop("__a", "__b")


def trapezoid(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Area under the line through the points of each group, in the order of x."""
    w = Window.partitionBy(*by).orderBy(x)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.withColumn("__p", part).groupBy(*by).agg(F.coalesce(F.sum("__p"), F.lit(0.0)).alias("area"))


def merged_points(df: DataFrame, x: str, y: str, series: str) -> DataFrame:
    """One point for every x of several series; equal x take the y of the first series."""
    return df.groupBy(x).agg(F.min_by(y, series).alias(y))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of every group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
