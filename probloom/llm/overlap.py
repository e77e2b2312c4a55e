"""Same or near-same records across splits.

Every record is canonicalised: text in lower case, without punctuation, outer or
repeated white space, numbers in one unit and NULL where outside their domain.
Exact copies meet by a hash of the whole canonical record. For near copies a
record is hashed by the cells its values fall in; evaluation records are hashed
into every cell their tolerance reaches, so records within tolerance always
share a hash, and only records that share one are compared, value by value.

One compared field may be missing in a pair. The fields are dealt to three
groups and hashes are built of two groups at a time ("bands"): a missing field
spoils two of the three bands at most, and a rule on where the missing field
lies makes exactly one band answer for any pair. No pair is found twice, and no
group of records is ever paired with itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probloom.runtime import stored
from probloom.schema import Feature, plain

#: A cell is so many tolerances wide: wider cells give fewer hashes and more comparisons.
CELL = 16
BANDS = ((0, 1), (1, 2), (0, 2))
#: Number of the band in which exact copies meet.
COPIES = 3


def canonical(text: Column) -> Column:
    """Text for comparison: lower case, no punctuation or symbols, single white space; NULL where nothing is left."""
    bare = plain(F.regexp_replace(text, r"[\p{P}\p{S}]+", " "))
    return F.when(bare != "", bare)


def _hashed(rows: DataFrame, groups: list[list[Feature]], band: int, window_s: int, probe: bool) -> DataFrame:
    """A row for every hash of a record in a band; records that miss a field of the band have none.

    A record has the hash of its cell; a probe has those of every cell that a
    value +- tolerance touches, two a value at most.
    """
    used = [f for g in (BANDS[band] if band < COPIES else range(3)) for f in groups[g]]
    near = [f for f in used if f.tolerance and band < COPIES]
    values = [("at", float(window_s), 4.0 * window_s)] + [(f.name, f.tolerance * 1.001, CELL * f.tolerance) for f in near]
    exact = ["whole"] if band == COPIES else ["texts", *[f.name for f in used if f not in near]]
    rest = [f for g in {0, 1, 2} - set(BANDS[band % COPIES]) for f in groups[g]]
    spoilt = reduce(lambda a, b: a | b, [F.col(f.name).isNull() for f in rest], F.lit(False))
    out = rows.where(reduce(lambda a, b: a & b, [F.col(f.name).isNotNull() for f in used], F.lit(True)))
    cell = lambda name, by, width: F.floor((F.col(name) + F.lit(by)) / F.lit(width))
    if not probe:
        return out.select(F.xxhash64(*[cell(name, 0.0, width) for name, _, width in values], *exact).alias("h"), F.col("record_id").alias("id"), "at", spoilt.alias("spoilt"))
    low, two = [f"__l{i}" for i in range(len(values))], [f"__t{i}" for i in range(len(values))]
    out = out.select("record_id", "at", spoilt.alias("spoilt"), *exact, *[cell(name, -reach, width).alias(c) for c, (name, reach, width) in zip(low, values)], *[(cell(name, reach, width) - cell(name, -reach, width)).cast("int").alias(c) for c, (name, reach, width) in zip(two, values)])
    # A number for each choice of cells: its bits go to the values that touch two.
    total = reduce(lambda a, b: a + b, [F.col(c) for c in two])
    out = out.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), total) - 1)).alias("__n"))
    bit, cells = F.lit(0), []
    for l, t in zip(low, two):
        cells.append(F.col(l) + F.col(t) * F.call_function("getbit", F.col("__n"), bit).cast("long"))
        bit = bit + F.col(t)
    return out.select(F.xxhash64(*cells, *exact).alias("h"), F.col("record_id").alias("id"), "at", "spoilt")


def cross_split_pairs(records: DataFrame, fields: list[Feature], window_hours: int = 48, texts: tuple[str, ...] = ()) -> DataFrame:
    """(record_a, record_b, split, source, exact): pairs of one record in train and one in valid or test.

    ``records``: record_id, split, source, at (seconds, may be fractional) and
    the fields, known values or NULL. Two records pair when they were measured
    within ``window_hours`` and every field differs by no more than its
    tolerance; at most one field may be missing in either or both, and is left
    out. ``texts`` must agree in canonical form (two empty ones do). ``split`` and ``source`` are those of the evaluation record. Records
    with a null id, split or time, with two missing fields, or of another split
    pair with none; repeated deliveries of an id count once; an empty table
    gives an empty result.
    """
    groups = [fields[g::3] for g in range(3)]
    window_s = window_hours * 3600
    lost = reduce(lambda a, b: a + b, [F.col(f.name).isNull().cast("int") for f in fields])
    rows = records.select("record_id", plain(F.col("split")).alias("split"), "source", F.col("at").cast("double").alias("at"), F.xxhash64(*[canonical(F.col(t)) for t in texts], F.lit(len(texts))).alias("texts"), *[F.col(f.name).cast("double").alias(f.name) for f in fields])
    rows = rows.where(F.col("record_id").isNotNull() & F.col("at").isNotNull() & F.col("split").isin("train", "valid", "test") & (lost <= 1)).dropDuplicates(["record_id"])
    rows = rows.withColumn("whole", F.when(lost == 0, F.xxhash64("texts", *[f.name for f in fields])))  # the canonical record
    rows = stored(rows, "split-records")
    train, other = rows.where(F.col("split") == "train"), rows.where(F.col("split") != "train")
    # Hashes travel with the id and time alone; the few records that meet are fetched for comparison.
    met = []
    for band in (*range(len(BANDS)), COPIES):
        a, b = _hashed(train, groups, band, window_s, False).alias("a"), _hashed(other, groups, band, window_s, True).alias("b")
        on = (F.col("a.h") == F.col("b.h")) & (F.abs(F.col("a.at") - F.col("b.at")) <= window_s)
        # Bands after the first are for pairs of which one misses a field of the group left out: few records on one side.
        sides = [(a, b)] if band in (0, COPIES) else [(a.where("spoilt"), b), (a.where("NOT spoilt"), b.where("spoilt"))]
        met += [p.join(q, on).select(F.lit(band).alias("band"), F.col("a.id").alias("x"), F.col("b.id").alias("y")) for p, q in sides]
    met = stored(reduce(DataFrame.unionByName, met), "met")
    pairs = met.join(train.alias("a"), F.col("x") == F.col("a.record_id")).join(other.alias("b"), F.col("y") == F.col("b.record_id"))
    apart, same, missing, out = [], [], [], [[], [], []]
    for g, members in enumerate(groups):
        for f in members:
            x, y = F.col(f"a.{f.name}"), F.col(f"b.{f.name}")
            apart.append(F.coalesce(F.abs(x - y) <= F.lit((f.tolerance or 0) * (1 + 1e-9)), F.lit(True)))
            same.append(x.eqNullSafe(y))
            gone = (x.isNull() | y.isNull()).cast("int")
            missing.append(gone)
            out[g].append(gone)
    count = lambda xs: reduce(lambda p, q: p + q, xs, F.lit(0))
    # The band that answers: that of copies, else the first, unless a field of the group that another band leaves out is missing.
    own = F.when(F.col("a.whole") == F.col("b.whole"), F.lit(COPIES)).when(count(out[0]) == 1, F.lit(1)).when(count(out[1]) == 1, F.lit(2)).otherwise(F.lit(0))
    close = reduce(lambda p, q: p & q, apart, (F.col("a.texts") == F.col("b.texts")) & (count(missing) <= 1) & (F.col("band") == own))
    return pairs.where(close).select(
        F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"), F.col("y").alias("record_id"), F.col("b.split").alias("split"), F.col("b.source").alias("source"), reduce(lambda p, q: p & q, same).alias("exact")
    )


def overlap_report(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per evaluation split and source: records, records met in train, pairs and exact pairs.

    Splits other than valid and test aren't reported; a null source is a source of its own.
    """
    held = records.select("record_id", plain(F.col("split")).alias("split"), "source").where(F.col("split").isin("valid", "test")).dropDuplicates(["record_id"])
    all_of = held.groupBy("split", "source").agg(F.count(F.lit(1)).alias("records"))
    per = pairs.groupBy("record_id", "split", "source").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("exact").cast("long")).alias("exact_pairs"))
    hit = per.groupBy(F.col("split").alias("s"), F.col("source").alias("c")).agg(F.count(F.lit(1)).alias("overlapping"), F.sum("pairs").alias("pairs"), F.sum("exact_pairs").alias("exact_pairs"))
    joined = all_of.join(hit, (F.col("split") == F.col("s")) & F.col("source").eqNullSafe(F.col("c")), "left")
    return joined.select("split", "source", "records", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("overlapping", "pairs", "exact_pairs")])
