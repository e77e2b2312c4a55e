"""Session helpers shared by every operator: table access, durable
intermediate tables and skew-safe numbering."""

from __future__ import annotations

import atexit
import math
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SCRATCH: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir`` of the session.

    Only where none is named and all runs on one machine, a temporary folder is
    made and set as the checkpoint folder; on a cluster executors couldn't read
    one another's folders, so that is an error.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="probloom-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors and gives later plans
    column pruning and size statistics. The table goes when the program ends.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/probloom/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(at)
    _SCRATCH.append((spark, at))
    out = spark.read.schema(df.schema).parquet(at)
    out._probloom_at = at
    return out


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared folder, deleted when the program ends."""
    at = f"{shared_dir(spark)}/probloom/{label}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append((spark, at))
    return at


def freed(*frames: DataFrame) -> None:
    """Delete stored tables that no later plan reads; other frames are left alone."""
    for df in frames:
        at = getattr(df, "_probloom_at", None)
        for entry in [e for e in _SCRATCH if e[1] == at]:
            _SCRATCH.remove(entry)
            _delete(*entry)


def _delete(spark: SparkSession, at: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone already
        pass


def _clean() -> None:
    for entry in _SCRATCH:
        _delete(*entry)


class Timer:
    """Seconds of a block, and of several blocks by name."""

    def __init__(self) -> None:
        self.elapsed: dict[str, float] = {}

    @contextmanager
    def measure(self, name: str = "block") -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.elapsed[name] = self.elapsed.get(name, 0.0) + time.perf_counter() - began


#: Rows of one salt of a group, rows of a table that may be broadcast.
SALT_ROWS, BROADCAST_ROWS = 100_000, 50_000


def salts_for(rows: int) -> int:
    """Buckets that keep each of a group of ``rows`` rows small enough for one task."""
    return max(1, math.ceil(rows / SALT_ROWS))


def beside(df: DataFrame, small: DataFrame, on: str, salt: Column, rows: int) -> DataFrame:
    """Left join ``df`` with ``small`` (a row per group; column ``__h`` is the group, NULL too): broadcast up to BROADCAST_ROWS groups.

    With more groups both sides are salted by ``salt`` as the number of rows
    of ``df`` asks, so that no hot group is in one task.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(small), F.col(on).eqNullSafe(F.col("__h")), "left").drop("__h")
    n = min(salts_for(rows), 1024)
    wide = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left = df.withColumn("__own_salt", F.pmod(F.xxhash64(salt), F.lit(n)).cast("int"))
    return left.join(wide, F.col(on).eqNullSafe(F.col("__h")) & (F.col("__own_salt") == F.col("__salt")), "left").drop("__h", "__salt", "__own_salt")


atexit.register(_clean)


def salted_rank(df: DataFrame, group: list[str], order: list[Column], out: str, salts: int | None = None) -> DataFrame:
    """Number the rows of every group from 0, in a fixed pseudo-random order.

    ``order`` must identify a row within its group. A hash of it spreads the
    group over ``salts`` buckets (by default as many as all rows ask), each is numbered on its own and shifted by
    the counts of the buckets before it, so a group that holds a third of all
    rows is never sorted in one task. The numbering is dense and repeatable.
    """
    salt, at = f"__{out}_salt", f"__{out}_at"
    salts = salts or salts_for(df.count())
    rows = df.withColumn(salt, F.pmod(F.xxhash64(F.lit(out), *order), F.lit(salts)).cast("int"))
    counts = rows.groupBy(*group, salt).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(at, F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    counts = counts.select(*[F.col(c).alias(f"__k_{c}") for c in [*group, salt]], at)
    inner = Window.partitionBy(*group, salt).orderBy(F.xxhash64(F.lit(out), F.lit(1), *order), *order)
    rows = rows.withColumn("__in", F.row_number().over(inner) - 1)
    on = [rows[c].eqNullSafe(counts[f"__k_{c}"]) for c in [*group, salt]]
    keep = [c for c in df.columns]
    return rows.join(counts, on).select(*keep, (F.col("__in") + F.col(at)).cast("long").alias(out))
