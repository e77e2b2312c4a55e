"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probloom.llm import clusters, mixing, neighbours, overlap, packing, proportions, sentences, tokens
from probloom.runtime import stored, table
from probloom.schema import Feature, features_of, known, plain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- most similar vectors ---------------------------------------------------

PIXELS = 3072


def _image_index(spark: SparkSession, sf_dir: str) -> neighbours.VectorIndex:
    return neighbours.build_index(table(spark, sf_dir, "cifar10_batches"), "image_id", "pixel_data", PIXELS, 0, 255)


@query(
    "p5_found",
    """
    WITH v AS (
      SELECT image_id, any_value(pixel_data::DOUBLE[]) AS p FROM cifar10_batches
      WHERE len(pixel_data) = 3072 AND len(list_filter(pixel_data, lambda x: x IS NOT NULL AND x BETWEEN 0 AND 255)) = 3072
      GROUP BY image_id),
    d AS (
      SELECT b.probe_no, o.image_id, list_distance(v.p, o.p) AS d
      FROM image_probes b JOIN v USING (image_id) JOIN v o ON o.image_id <> b.image_id)
    SELECT probe_no, image_id FROM d
    QUALIFY row_number() OVER (PARTITION BY probe_no ORDER BY d, image_id) <= 10""",
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "image_probes")
    near = neighbours.search(_image_index(spark, sf_dir), probes.select(F.col("image_id").alias("id")), 10, exact=True)
    return probes.join(near, probes.image_id == near.query_id).select("probe_no", F.col("neighbour_id").alias("image_id"))


@query("p5_neighbours")
def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest images, by the curves alone, of every image whose id is divisible by 20."""
    index = _image_index(spark, sf_dir)
    return neighbours.search(index, index.rows.select("id").where(F.col("id") % 20 == 0), 10).select("query_id", "neighbour_id", F.round("distance", 6).alias("distance"), "rank")


@query("p5_recall")
def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the ten nearest images of every image whose id is divisible by 20 the curves find, by rank."""
    index = _image_index(spark, sf_dir)
    found = neighbours.search(index, index.rows.select("id").where(F.col("id") % 20 == 0), 10, exact=True)
    return found.groupBy("rank").agg(F.count(F.lit(1)).alias("queries"), F.count_if("by_curve").alias("found"), F.round(F.avg(F.col("by_curve").cast("int")), 6).alias("recall"))


# --- overlaps across splits -------------------------------------------------

#: Milligrams per decilitre of one mmol/L of glucose.
MMOL = 18.016
SOURCES = {"glass": "lab_code", "pima_indians_diabetes": "clinic_code"}


def split_records(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, list[Feature]]:
    """Records of a table with known values of its compared fields, glucose in mg/dL."""
    spec = features_of(table(spark, sf_dir, "feature_domain"), name)
    fields = [f for f in spec.values() if f.tolerance is not None]
    df = table(spark, sf_dir, name)
    value = {f.name: F.col(f.name) for f in fields}
    if "glucose" in value:
        value["glucose"] = F.col("glucose") * F.when(plain(F.col("glucose_unit")) == "mmol/l", F.lit(MMOL)).otherwise(F.lit(1.0))
    at = F.unix_micros(F.col("measured_at").cast("timestamp")) / 1e6
    return df.select("record_id", "split", F.col(SOURCES[name]).alias("source"), at.alias("at"), *[known(value[f.name], f).alias(f.name) for f in fields]), fields


def _p3_sql() -> str:
    parts = []
    for name, fields in {
        "glass": "ri na2o mgo al2o3 sio2 k2o cao bao fe203".split(),
        "pima_indians_diabetes": "pregnant glucose bmi diabetes_pedigree age".split(),
    }.items():
        value = {f: f"t.{f}" for f in fields} | ({"glucose": "t.glucose * CASE WHEN lower(trim(t.glucose_unit)) = 'mmol/l' THEN 18.016 ELSE 1 END"} if "glucose" in fields else {})
        pick = lambda f, c: f"(SELECT {c} FROM feature_domain WHERE table_name = '{name}' AND field_name = '{f}')"
        known_ = ", ".join(f"CASE WHEN {value[f]} BETWEEN {pick(f, 'domain_lo')} AND {pick(f, 'domain_hi')} AND NOT isnan(({value[f]})::DOUBLE) THEN {value[f]} END AS {f}" for f in fields)
        close = " AND ".join(f"coalesce(abs(a.{f} - b.{f}) <= {pick(f, 'overlap_tolerance')} * (1 + 1e-9), true)" for f in fields)
        gone = " + ".join(f"(a.{f} IS NULL OR b.{f} IS NULL)::INT" for f in fields)
        parts.append(f"""SELECT '{name}' AS table_name, least(a.record_id, b.record_id) AS record_a, greatest(a.record_id, b.record_id) AS record_b
          FROM (SELECT DISTINCT record_id, lower(trim(split)) AS split, measured_at, {known_} FROM {name} t) a
          JOIN (SELECT DISTINCT record_id, lower(trim(split)) AS split, measured_at, {known_} FROM {name} t) b
          ON a.split = 'train' AND b.split IN ('valid', 'test') AND a.measured_at BETWEEN b.measured_at - INTERVAL 48 HOUR AND b.measured_at + INTERVAL 48 HOUR
          AND {close} AND {gone} <= 1""")
    return " UNION ALL ".join(parts)


@query("p3_found", _p3_sql())
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = []
    for name in SOURCES:
        records, fields = split_records(spark, sf_dir, name)
        found.append(overlap.cross_split_pairs(records, fields).select(F.lit(name).alias("table_name"), "record_a", "record_b"))
    return found[0].unionByName(found[1])


def _p3_report_sql() -> str:
    pairs = _p3_sql()
    ends = " UNION ALL ".join(
        f"SELECT DISTINCT '{t}' AS table_name, record_id, lower(trim(split)) AS split, {c} AS source FROM {t} WHERE record_id IS NOT NULL AND lower(trim(split)) IN ('valid', 'test')" for t, c in SOURCES.items()
    )
    return f"""WITH p AS ({pairs}), e AS ({ends}),
      m AS (SELECT e.table_name, e.record_id, e.split, e.source, count(p.record_a) AS pairs FROM e LEFT JOIN p ON p.table_name = e.table_name AND e.record_id IN (p.record_a, p.record_b) GROUP BY ALL)
      SELECT table_name, split, source, count(*) AS records, count_if(pairs > 0)::BIGINT AS overlapping, sum(pairs)::BIGINT AS pairs FROM m GROUP BY ALL"""


@query("p3_overlaps", _p3_report_sql())
def p3_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's counts of records and pairs, without those of exact copies."""
    return p3_report(spark, sf_dir).drop("exact_pairs")


@query("p3_report")
def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps with the training split per evaluation split and lab or clinic."""
    out = []
    for name in SOURCES:
        records, fields = split_records(spark, sf_dir, name)
        pairs = stored(overlap.cross_split_pairs(records, fields), "overlaps")
        out.append(overlap.overlap_report(records, pairs).select(F.lit(name).alias("table_name"), "*"))
    return out[0].unionByName(out[1])


# --- similarity clusters ----------------------------------------------------


def glass_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Feature]]:
    fields = [f for f in features_of(table(spark, sf_dir, "feature_domain"), "glass").values() if f.step is not None]
    return table(spark, sf_dir, "glass").select("record_id", *[known(F.col(f.name), f).alias(f.name) for f in fields]), fields


def _p4_sql() -> str:
    fields = "ri na2o mgo al2o3".split()
    pick = lambda f, c: f"(SELECT {c} FROM feature_domain WHERE table_name = 'glass' AND field_name = '{f}')"
    known_ = " AND ".join(f"{f} BETWEEN {pick(f, 'domain_lo')} AND {pick(f, 'domain_hi')} AND NOT isnan({f})" for f in fields)
    scaled = ", ".join(f"{f} / {pick(f, 'cluster_step')} AS {f}" for f in fields)
    gap = " + ".join(f"(a.{f} - b.{f}) ** 2" for f in fields)
    return f"""WITH RECURSIVE r AS MATERIALIZED (SELECT DISTINCT ON (record_id) record_id, {scaled} FROM glass WHERE {known_}),
      n AS MATERIALIZED (SELECT a.record_id AS x, b.record_id AS y FROM r a JOIN r b ON abs(a.ri - b.ri) <= 1.000001 AND {gap} <= 1 + 1e-9 AND a.record_id <> b.record_id),
      w AS (SELECT record_a, record_b, record_a AS here FROM glass_pairs WHERE record_a IN (SELECT record_id FROM r) UNION SELECT w.record_a, w.record_b, n.y FROM w JOIN n ON n.x = w.here)
      SELECT DISTINCT record_a, record_b FROM w WHERE here = record_b"""


@query("p4_found", _p4_sql())
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = clusters.similarity_clusters(*glass_points(spark, sf_dir)).select("record_id", "cluster_id")
    pairs = table(spark, sf_dir, "glass_pairs").select("record_a", "record_b")
    wanted = pairs.select(F.explode(F.array("record_a", "record_b")).alias("record_id")).distinct()
    of = stored(members.join(wanted, "record_id"), "pair-members")
    side = lambda c: of.select(F.col("record_id").alias(c), F.col("cluster_id").alias(f"in_{c}"))
    return pairs.join(side("record_a"), "record_a").join(side("record_b"), "record_b").where("in_record_a = in_record_b").select("record_a", "record_b").distinct()


@query("p4_clusters")
def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster with its size and most typical specimens; strays are marked."""
    points, fields = glass_points(spark, sf_dir)
    return clusters.describe_clusters(stored(clusters.similarity_clusters(points, fields), "members"), fields)


# --- samples of target proportions ------------------------------------------

CATEGORY = {"glass": "glass_type", "pima_indians_diabetes": "class_code"}


def categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of both tables with their recorded category, NULL where outside its codes."""
    parts = []
    for name, c in CATEGORY.items():
        spec = features_of(table(spark, sf_dir, "feature_domain"), name)[c]
        parts.append(table(spark, sf_dir, name).select(F.lit(name).alias("table_name"), "record_id", "cohort_key", known(F.col(c), spec).cast("int").alias("category_code")))
    return parts[0].unionByName(parts[1])


@query(
    "p2_found",
    """
    WITH r AS (
      SELECT DISTINCT 'glass' AS table_name, record_id, cohort_key, glass_type AS c FROM glass
      UNION ALL SELECT DISTINCT 'pima_indians_diabetes', record_id, cohort_key, class_code FROM pima_indians_diabetes),
    n AS (SELECT table_name, cohort_key, c, count(*) AS available FROM r WHERE c IS NOT NULL GROUP BY ALL)
    SELECT request_no, category_code FROM sample_requests q
    LEFT JOIN n ON n.table_name = q.table_name AND n.cohort_key = q.cohort_key AND n.c = q.category_code
    WHERE coalesce(available, 0) < greatest(min_rows, floor(target_share * sample_size + 0.5 + 1e-9))""",
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of which the drawn sample holds fewer records than needed because the cohort does."""
    return p2_report(spark, sf_dir).where("drawn < needed AND available < needed").select("request_no", "category_code")


@query("p2_sample")
def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn records of every request."""
    return proportions.matched_sample(categorised(spark, sf_dir), table(spark, sf_dir, "sample_requests"))[1]


@query("p2_report")
def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, need, supply, allocation and drawn records of every request and category."""
    plan, sample = proportions.matched_sample(categorised(spark, sf_dir), table(spark, sf_dir, "sample_requests"))
    return proportions.sample_report(plan, sample)


@query(
    "p2_totals",
    """
    WITH r AS (
      SELECT DISTINCT 'glass' AS table_name, record_id, cohort_key, glass_type AS c FROM glass
      UNION ALL SELECT DISTINCT 'pima_indians_diabetes', record_id, cohort_key, class_code FROM pima_indians_diabetes),
    n AS (SELECT table_name, cohort_key, c, count(*) AS available FROM r WHERE c IS NOT NULL GROUP BY ALL)
    SELECT request_no, least(any_value(sample_size), coalesce(sum(available), 0))::BIGINT AS drawn, least(any_value(sample_size), coalesce(sum(available), 0))::BIGINT AS different, 0::BIGINT AS strangers
    FROM sample_requests q LEFT JOIN n ON n.table_name = q.table_name AND n.cohort_key = q.cohort_key AND n.c = q.category_code GROUP BY 1""",
)
def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per request: records drawn, different ones, and any that aren't of the cohort and category asked."""
    held = stored(categorised(spark, sf_dir), "categorised")
    requests = table(spark, sf_dir, "sample_requests")
    plan, sample = proportions.matched_sample(held, requests)
    sample = stored(sample, "sample")
    of = sample.join(plan.select("request_no", "category_code", "table_name", "cohort_key"), ["request_no", "category_code"])
    good = of.join(held.dropDuplicates(["table_name", "record_id"]), ["table_name", "cohort_key", "category_code", "record_id"], "left_semi").groupBy("request_no").agg(F.count(F.lit(1)).alias("good"))
    per = sample.groupBy("request_no").agg(F.count(F.lit(1)).alias("drawn"), F.countDistinct("record_id").alias("different"))
    out = requests.select("request_no").distinct().join(per, "request_no", "left").join(good, "request_no", "left").na.fill(0)
    return out.select("request_no", "drawn", "different", (F.col("drawn") - F.col("good")).alias("strangers"))


# --- containers and mixes ---------------------------------------------------

#: A character that isn't white space, for DuckDB.
VISIBLE = r"[^\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SIZE_SQL = f"CASE WHEN regexp_matches(text, '{VISIBLE}') THEN octet_length(encode(text)) ELSE 0 END"


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "container_specs").select("spec_code", F.col("capacity_tokens").alias("capacity"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokens.sized_documents(table(spark, sf_dir, "documents")), _specs(spark, sf_dir))


@query("p6_found", f"SELECT spec_code, doc_id FROM documents, container_specs WHERE {SIZE_SQL} > capacity_tokens")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose tokens lie in more than one container."""
    spread = _packed(spark, sf_dir).groupBy("spec_code", "doc_id").agg(F.count(F.lit(1)).alias("parts"))
    return spread.where("parts > 1").select("spec_code", "doc_id")


@query("p6_packed")
def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or piece of one, per spec."""
    return _packed(spark, sf_dir)


@query(
    "p6_totals",
    f"""
    WITH s AS (SELECT doc_id, {SIZE_SQL} AS size FROM documents)
    SELECT spec_code, count(*) AS documents, sum(size)::BIGINT AS tokens, sum(ceil(size / capacity_tokens))::BIGINT AS pieces, count_if(size > capacity_tokens)::BIGINT AS cut, 0::BIGINT AS overfull, 0::BIGINT AS gaps
    FROM s, container_specs WHERE size > 0 GROUP BY 1""",
)
def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per spec: what was packed, containers above the capacity and documents whose pieces don't follow one another."""
    packed = stored(_packed(spark, sf_dir), "containers")
    docs = packed.groupBy("spec_code", "doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.max("end").alias("to"), F.min("start").alias("from"))
    per = docs.groupBy("spec_code").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces"), F.count_if(F.col("pieces") > 1).alias("cut"), F.count_if((F.col("to") != F.col("tokens")) | (F.col("from") != 0)).alias("gaps"))
    load = packed.groupBy("spec_code", "container").agg(F.sum(F.col("end") - F.col("start")).alias("load")).join(F.broadcast(_specs(spark, sf_dir)), "spec_code")
    return per.join(load.groupBy("spec_code").agg(F.count_if(F.col("load") > F.col("capacity")).alias("overfull")), "spec_code").select("spec_code", "documents", "tokens", "pieces", "cut", "overfull", "gaps")


@query("p6_report")
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, their fill and the gaps of their source shares, per spec."""
    return packing.pack_report(stored(_packed(spark, sf_dir), "containers"), _specs(spark, sf_dir))


@query(
    "p7_found",
    f"""
    WITH s AS (SELECT lower(trim(source)) AS source, sum({SIZE_SQL}) AS size FROM documents WHERE trim(source) <> '' GROUP BY ALL)
    SELECT plan_no, p.source FROM mix_plans p LEFT JOIN s USING (source)
    WHERE target_share * size_factor * (SELECT sum(size) FROM s) > max_repeats * coalesce(size, 0)""",
)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of which all that may be used was placed, and it isn't enough."""
    return _mixed(spark, sf_dir).where("used_tokens = most_tokens AND used_tokens < wanted_tokens").select("plan_no", "source")


@query("p7_mix")
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed blocks of every plan as parts of documents."""
    return mixing.mix(tokens.sized_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_plans"))


@query(
    "p7_report",
    f"""
    WITH s AS (SELECT lower(trim(source)) AS source, sum({SIZE_SQL})::BIGINT AS size FROM documents WHERE trim(source) <> '' GROUP BY ALL),
    q AS (SELECT plan_no, p.source, target_share, target_share * size_factor * (SELECT sum(size) FROM s)::BIGINT AS wanted, coalesce(size, 0) AS size, max_repeats * coalesce(size, 0) AS most FROM mix_plans p LEFT JOIN s USING (source)),
    u AS (SELECT *, least(round(wanted), most)::BIGINT AS used FROM q)
    SELECT plan_no, source, target_share, round(used / greatest(sum(used) OVER (PARTITION BY plan_no), 1), 6) AS actual_share, round(wanted, 3) AS wanted_tokens, size AS source_tokens, most AS most_tokens, used AS used_tokens,
      CASE WHEN size > 0 THEN ceil(used / size) ELSE 0 END::INT AS passes, wanted > most AS short FROM u""",
)
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of every plan and source."""
    return _mixed(spark, sf_dir).withColumn("wanted_tokens", F.round("wanted_tokens", 3))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, plans = tokens.sized_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_plans")
    return mixing.mix_report(items, plans, mixing.mix(items, plans))


# --- sentences --------------------------------------------------------------


@query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentences.sentence_units(documents, sentences.train(documents))


@query("p8_lengths")
def p8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and characters in units per language as recorded."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    units = sentences.sentence_units(documents, sentences.train(documents))
    per = units.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.sum(F.col("sent_end") - F.col("sent_start")).alias("chars"))
    lang = table(spark, sf_dir, "documents").select("doc_id", plain(F.col("lang")).alias("lang"))
    return lang.join(per, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("units").alias("units"), F.round(F.sum("chars") / F.sum("units"), 3).alias("mean_chars"))
