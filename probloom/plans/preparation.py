"""Queries of the general data-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probloom.operators.impute import fill_missing
from probloom.plans.catalog import query
from probloom.runtime import stored, table
from probloom.schema import features_of, known, plain

P1_TARGETS = ["blood_pressure", "triceps_skin", "insulin_2h", "class_code"]
P1_NUMERIC = ["pregnant", "glucose", "blood_pressure", "triceps_skin", "insulin_2h", "bmi", "diabetes_pedigree", "age"]


def filled_patients(spark: SparkSession, sf_dir: str, df: DataFrame | None = None) -> DataFrame:
    spec = features_of(table(spark, sf_dir, "feature_domain"), "pima_indians_diabetes")
    df = table(spark, sf_dir, "pima_indians_diabetes") if df is None else df
    glucose = F.col("glucose") * F.when(plain(F.col("glucose_unit")) == "mmol/l", F.lit(18.016)).otherwise(F.lit(1.0))
    return fill_missing(df, "record_id", "clinic_code", [spec[c] for c in P1_NUMERIC], [spec["class_code"]], P1_TARGETS, dict.fromkeys(P1_TARGETS, 0), {"glucose": glucose})


@query("p1_filled")
def p1_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every patient record with the four fields filled and marked."""
    return filled_patients(spark, sf_dir)


@query(
    "p1_found",
    " UNION ALL ".join(
        f"""SELECT DISTINCT record_id, '{f}' AS field_name FROM pima_indians_diabetes, feature_domain
        WHERE table_name = 'pima_indians_diabetes' AND field_name = '{f}' AND NOT coalesce({'list_contains(domain_codes, class_code)' if f == 'class_code' else f'NOT isnan({f}) AND {f} BETWEEN domain_lo AND domain_hi'}, false)"""
        for f in P1_TARGETS
    ),
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled cells; a fill outside its domain would not count."""
    spec = features_of(table(spark, sf_dir, "feature_domain"), "pima_indians_diabetes")
    df = table(spark, sf_dir, "pima_indians_diabetes").select("record_id", "clinic_code", "glucose_unit", *P1_NUMERIC, "class_code")
    cells = F.array(*[F.when(F.col(f"{t}_filled") & known(F.col(t), spec[t]).isNotNull(), F.lit(t)) for t in P1_TARGETS])
    return filled_patients(spark, sf_dir, df).select("record_id", F.explode(F.array_compact(cells)).alias("field_name"))


@query(
    "p1_counts",
    " UNION ALL ".join(
        f"""SELECT '{f}' AS field_name, count(*) AS records, count_if(gone)::BIGINT AS filled, 0::BIGINT AS wrong, 0::BIGINT AS changed FROM (SELECT record_id, any_value(NOT coalesce({'list_contains(domain_codes, class_code)' if f == 'class_code' else f'NOT isnan({f}) AND {f} BETWEEN domain_lo AND domain_hi'}, false)) AS gone
        FROM pima_indians_diabetes, feature_domain WHERE table_name = 'pima_indians_diabetes' AND field_name = '{f}' GROUP BY 1)"""
        for f in P1_TARGETS
    ),
)
def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per field: records, filled cells, fills outside the domain, and known cells that came out changed."""
    spec = features_of(table(spark, sf_dir, "feature_domain"), "pima_indians_diabetes")
    before = table(spark, sf_dir, "pima_indians_diabetes").dropDuplicates(["record_id"])
    before = stored(before.withColumns({f"was_{t}": F.col(t) for t in P1_TARGETS}), "patients")
    after = stored(filled_patients(spark, sf_dir, before), "filled")
    cells = [F.struct(F.lit(t).alias("field_name"), F.col(f"{t}_filled").alias("filled"), known(F.col(t), spec[t]).isNull().alias("wrong"), (~F.col(f"{t}_filled") & ~F.col(t).eqNullSafe(F.col(f"was_{t}"))).alias("changed")) for t in P1_TARGETS]
    rows = after.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return rows.groupBy("field_name").agg(F.count(F.lit(1)).alias("records"), *[F.count_if(c).alias(c) for c in ("filled", "wrong", "changed")])


@query("p1_error")
def p1_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills of known cells against their values, a tenth of the cells of each field hidden in turn by hash.

    ``error``: root mean squared error (share of wrong codes for the class);
    ``plain_error``: that of the mean of the clinic's cells that stayed (of the commonest code).
    """
    spec = features_of(table(spark, sf_dir, "feature_domain"), "pima_indians_diabetes")
    df = table(spark, sf_dir, "pima_indians_diabetes").dropDuplicates(["record_id"])
    hidden = {t: known(F.col(t), spec[t]).isNotNull() & (F.pmod(F.xxhash64("record_id", F.lit(t)), F.lit(10)) == 0) for t in P1_TARGETS}
    df = df.select(
        "record_id", "clinic_code", "glucose_unit", *[c for c in P1_NUMERIC if c not in P1_TARGETS], *[F.when(~hidden[t], F.col(t)).alias(t) for t in P1_TARGETS],
        *[F.when(hidden[t], F.col(t).cast("double")).alias(f"true_{t}") for t in P1_TARGETS], *[known(F.when(~hidden[t], F.col(t)), spec[t]).alias(f"left_{t}") for t in P1_TARGETS],
    )
    plain_of = df.groupBy(F.col("clinic_code").alias("clinic")).agg(*[F.avg(f"left_{t}").alias(f"plain_{t}") for t in P1_TARGETS[:-1]])
    common = df.agg(*[F.mode("left_class_code").alias("plain_class_code"), *[F.avg(f"left_{t}").alias(f"all_{t}") for t in P1_TARGETS[:-1]]])
    filled = stored(filled_patients(spark, sf_dir, df), "filled").join(plain_of, F.col("clinic").eqNullSafe(F.col("clinic_code")), "left").crossJoin(F.broadcast(common))  # one row
    cells = [F.struct(F.lit(t).alias("field_name"), F.col(f"true_{t}").alias("x"), F.col(t).cast("double").alias("y"), F.coalesce(f"plain_{t}", f"all_{t}" if t != "class_code" else "plain_class_code").alias("z")) for t in P1_TARGETS]
    rows = filled.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("x IS NOT NULL")
    miss = lambda c: F.when(F.first("field_name") == "class_code", F.avg((F.col("x") != F.col(c)).cast("double"))).otherwise(F.sqrt(F.avg(F.pow(F.col("x") - F.col(c), F.lit(2)))))
    return rows.groupBy("field_name").agg(F.count(F.lit(1)).alias("cells"), F.round(miss("y"), 6).alias("error"), F.round(miss("z"), 6).alias("plain_error"))
