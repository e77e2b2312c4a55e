import collections

from hypothesis import given, settings
from hypothesis import strategies as st

from probloom.llm import proportions as P

RECORDS = "table_name string, record_id long, cohort_key string, category_code int, available int"
REQUESTS = "request_no long, table_name string, cohort_key string, sample_size int, category_code int, target_share double, min_rows int, available int, plan string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 30), st.integers(0, 80)), min_size=1, max_size=7), st.integers(0, 150))
def test_allocation_fills_the_sample_within_bounds(leaves, size):
    rows = [{"code": i + 1, "share": s, "least": m, "available": a} for i, (s, m, a) in enumerate(leaves)]
    out = P.allocate(size, rows, P.TREES["glass"])
    assert all(0 <= out[x["code"]] <= x["available"] for x in rows)
    assert sum(out.values()) == min(size, sum(x["available"] for x in rows))
    if sum(min(x["least"], x["available"]) for x in rows) <= size:
        assert all(out[x["code"]] >= min(x["least"], x["available"]) for x in rows)


def test_quota_goes_to_siblings_before_cousins():
    rows = [{"code": c, "share": s, "least": 0, "available": a} for c, s, a in ((1, 0.3, 5), (2, 0.3, 500), (3, 0.2, 500), (5, 0.2, 500))]
    assert P.allocate(100, rows, P.TREES["glass"]) == {1: 5, 2: 55, 3: 20, 5: 20}
    rows[1]["available"] = 10
    assert P.allocate(100, rows, P.TREES["glass"]) == {1: 5, 2: 10, 3: 65, 5: 20}


def test_needed_rounds_halves_up():
    assert P.needed(0.15, 150, 0) == 23 and P.needed(0.1, 10, 4) == 4


def test_draws(spark):
    rec = [("glass", i, "c", 1 + i % 3, 9) for i in range(300)] + [("glass", 5, "c", 3, 9)] * 3 + [("glass", None, "c", 1, 9), ("glass", 900, None, 1, 9), ("glass", 901, "c", None, None)]
    req = [(1, "glass", "c", 60, k, 1 / 3, 5, 0, "p") for k in (1, 2, 3)] + [(2, "glass", "c", 1000, k, s, 0, 0, "p") for k, s in ((1, 0.9), (2, 0.1))] + [(3, "glass", "none", 10, 1, 1.0, 2, 0, "p"), (4, "glass", None, 10, 1, 1.0, 2, 0, "p")]
    plan, sample = P.matched_sample(spark.createDataFrame(rec, RECORDS), spark.createDataFrame(req, REQUESTS))
    rows = sample.collect()
    per = collections.Counter((r["request_no"], r["category_code"]) for r in rows)
    assert per == {(1, 1): 20, (1, 2): 20, (1, 3): 20, (2, 1): 100, (2, 2): 100}
    assert len({(r["request_no"], r["record_id"]) for r in rows}) == len(rows)
    short = {(r["request_no"], r["category_code"]): r["needed"] - r["allocated"] for r in plan.collect()}
    assert short[3, 1] == 10 and short[4, 1] == 10 and short[2, 1] == 800
    again = P.matched_sample(spark.createDataFrame(rec, RECORDS), spark.createDataFrame(req, REQUESTS))[1]
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows}


def test_empty(spark):
    plan, sample = P.matched_sample(spark.createDataFrame([], RECORDS), spark.createDataFrame([], REQUESTS))
    assert plan.count() == 0 and sample.count() == 0
