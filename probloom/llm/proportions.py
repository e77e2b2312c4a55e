"""Samples whose share of every category matches given targets.

The categories of a request form a tree. A request's size is handed down from
the root: a node gives each child its target part, at least what the child's
categories need and at most what they hold. What a category can't supply thus
goes first to its siblings, and only what the whole branch can't supply to its
cousins. At the leaves records are drawn by permuted dense rank: the records of
a cohort and category are numbered 0..n-1 in a fixed pseudo-random order, and a
request takes the numbers (a*j + b) mod n of its own a and b for j below its
quota, an equi-join that touches drawn records only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probloom.runtime import salted_rank, stored

#: Branches above each category code, by table.
TREES: dict[str, dict[int, tuple[str, ...]]] = {
    "glass": {1: ("window", "building"), 2: ("window", "building"), 3: ("window", "vehicle"), 4: ("window", "vehicle"), 5: ("other", "ware"), 6: ("other", "ware"), 7: ("other", "lamp")},
    "pima_indians_diabetes": {0: (), 1: ()},
}


def spread(quota: int, weight: list[float], least: list[int], most: list[int]) -> list[int]:
    """Whole parts of ``quota`` near its division by weight, each within its bounds.

    The parts add up to ``quota``, or to the nearest sum that the bounds allow.
    Parts of weight 0 get more than their least only once all others are full.
    """
    quota = max(min(quota, sum(most)), 0)
    if sum(least) > quota:  # the least parts alone are too many: cut the greatest of them to one level
        left, out = quota, [0] * len(least)
        for n, i in enumerate(sorted(range(len(least)), key=lambda i: (least[i], i))):
            out[i] = min(least[i], left // (len(least) - n))
            left -= out[i]
        for i in sorted(range(len(least)), key=lambda i: (out[i] - least[i], i))[:left]:
            out[i] += 1
        return out
    part: list[float] = [float(x) for x in least]
    for weights in (weight, [float(m) for m in most]):
        fixed: dict[int, float] = {}
        free = [i for i in range(len(part)) if weights[i] > 0 and most[i] > part[i]] if weights is not weight else [i for i in range(len(part)) if weights[i] > 0]
        rest_of = lambda: quota - sum(part[i] for i in range(len(part)) if i not in free)
        while free:
            rest, total = rest_of(), sum(weights[i] for i in free)
            want = {i: rest * weights[i] / total for i in free}
            high = [i for i in free if want[i] >= most[i]]
            low = [i for i in free if want[i] <= least[i]]
            over, under = sum(want[i] - most[i] for i in high), sum(least[i] - want[i] for i in low)
            clip = high if over >= under else low
            if not clip:
                part = [want.get(i, p) for i, p in enumerate(part)]
                break
            for i in clip:
                fixed[i] = part[i] = float(most[i] if clip is high else least[i])
            free = [i for i in free if i not in fixed]
        if sum(part) >= quota - 1e-9:
            break
    whole = [min(math.floor(p + 1e-9), m) for p, m in zip(part, most)]
    order = sorted(range(len(part)), key=lambda i: (whole[i] - part[i], i))
    while sum(whole) < quota:
        grown = False
        for i in order:
            if sum(whole) < quota and whole[i] < most[i] and (weight[i] > 0 or part[i] > whole[i] or all(whole[j] >= most[j] for j in order if weight[j] > 0)):
                whole[i] += 1
                grown = True
        if not grown:
            break
    return whole


def needed(share: float, size: int, least: int) -> int:
    """The greater of the least rows and the share of the size, rounded to the nearest whole number (halves up)."""
    return max(int(least), math.floor(share * size + 0.5 + 1e-9))


def allocate(size: int, leaves: list[dict], paths: dict[int, tuple[str, ...]]) -> dict[int, int]:
    """Rows of every category; leaves: code, share, least, available."""

    def down(quota: int, own: list[dict], depth: int) -> dict[int, int]:
        if len(own) == 1:
            return {own[0]["code"]: min(quota, own[0]["available"])}
        branches: dict[object, list[dict]] = {}
        for leaf in own:
            path = paths.get(leaf["code"], ())
            branches.setdefault(path[depth] if depth < len(path) else leaf["code"], []).append(leaf)
        kids = list(branches.values())
        part = spread(quota, [sum(x["share"] for x in k) for k in kids], [sum(min(x["least"], x["available"]) for x in k) for k in kids], [sum(x["available"] for x in k) for k in kids])
        out: dict[int, int] = {}
        for k, q in zip(kids, part):
            out |= down(q, k, depth + 1)
        return out

    return down(size, leaves, 0)


def _walk(name: str, request: int, code: int, n: int) -> tuple[int, int]:
    """Step and start of a request's permutation of 0..n-1."""
    if n <= 1:
        return 1, 0
    raw = int.from_bytes(hashlib.blake2b(f"{name}/{request}/{code}".encode(), digest_size=16).digest(), "big")
    step = raw % n or 1
    while math.gcd(step, n) != 1:
        step = step % n + 1
    return step, (raw >> 64) % n


RECORD = ("table_name", "cohort_key", "category_code", "record_id")
PLAN = "request_no long, table_name string, cohort_key string, category_code int, sample_size int, target_share double, min_rows int, needed int, available long, allocated long, step long, start long"


def plan_samples(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """The allocation of every request and category.

    ``requests``: a row per request and category (request_no, table_name,
    cohort_key, sample_size, category_code, target_share, min_rows); counts:
    (table_name, cohort_key, category_code, available). A request whose cohort
    is unknown or null has nothing available; one that asks more than the cohort
    holds takes all of it. Where the least rows of all categories exceed the
    size, the greatest of them are cut, so that as many as can be are kept. ``needed`` - ``allocated`` is what a
    category is short of.
    """
    on = ["table_name", "cohort_key", "category_code"]
    requests = requests.select("request_no", *on, "sample_size", "target_share", "min_rows").where("category_code IS NOT NULL AND sample_size IS NOT NULL")
    got = requests.join(counts.select(*on, "available"), on, "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("long"))
    leaf = F.struct("category_code", "target_share", "min_rows", "available")
    grouped = got.groupBy("request_no", "table_name", "cohort_key", "sample_size").agg(F.array_sort(F.collect_list(leaf)).alias("leaves"))  # as many as there are categories

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                paths = TREES.get(r.table_name, {})
                leaves = [{"code": int(x["category_code"]), "share": float(x["target_share"] or 0), "least": int(x["min_rows"] or 0), "available": int(x["available"])} for x in r.leaves]
                parts = allocate(int(r.sample_size), leaves, paths)
                for x in leaves:
                    step, begin = _walk(r.table_name, r.request_no, x["code"], x["available"])
                    out.append((r.request_no, r.table_name, r.cohort_key, x["code"], r.sample_size, x["share"], x["least"], needed(x["share"], r.sample_size, x["least"]), x["available"], parts[x["code"]], step, begin))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PLAN.split(", ")])

    return grouped.mapInPandas(run, PLAN)


def category_counts(records: DataFrame) -> DataFrame:
    """Distinct records per table, cohort and category; ``records``: table_name, record_id, cohort_key, category_code.

    Records without an id, cohort or category count for none.
    """
    return records.select(*RECORD).dropna().distinct().groupBy("table_name", "cohort_key", "category_code").agg(F.count(F.lit(1)).alias("available"))


def draw(records: DataFrame, plan: DataFrame) -> DataFrame:
    """(request_no, category_code, record_id) of the drawn records, none twice in a request."""
    group = ["table_name", "cohort_key", "category_code"]
    ranked = salted_rank(records.select(*RECORD).dropna().distinct(), group, [F.col("record_id")], "place")
    slots = plan.where("allocated > 0").select("request_no", *group, "available", "step", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("allocated") - 1)).alias("j"))
    slots = slots.select("request_no", *group, F.pmod(F.col("j") * F.col("step") + F.col("start"), F.col("available")).alias("place"))
    return slots.join(ranked, [*group, "place"]).select("request_no", "category_code", "record_id")


def matched_sample(records: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plan (also the report) and the sample."""
    held = stored(records.select(*RECORD).dropna().distinct(), "categorised")
    plan = stored(plan_samples(requests, category_counts(held)), "sample-plan")
    return plan, draw(held, plan)


def sample_report(plan: DataFrame, sample: DataFrame) -> DataFrame:
    """The plan with the records drawn of every category and what it is short of; a request and category without draws has 0."""
    on = ["request_no", "category_code"]
    drawn = sample.groupBy(*on).agg(F.countDistinct("record_id").alias("drawn"))
    out = plan.join(drawn, on, "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)).cast("long"))
    short = F.greatest(F.col("needed") - F.col("drawn"), F.lit(0)).alias("short")
    return out.select("request_no", "table_name", "cohort_key", "category_code", "sample_size", "target_share", "min_rows", "needed", "available", "allocated", "drawn", short)
