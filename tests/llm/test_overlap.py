import itertools

import numpy as np

from probloom.llm import overlap as O
from probloom.schema import Feature

FIELDS = [Feature("a", "continuous", 0, 9, tolerance=0.01), Feature("b", "continuous", 0, 9, tolerance=0.02), Feature("c", "discrete", 0, 9, tolerance=0.0), Feature("e", "continuous", 0, 9, tolerance=0.5), Feature("f", "continuous", 0, 9, tolerance=0.01)]
DDL = "record_id long, split string, source string, at double, a double, b double, c double, e double, f double, pairs int, exact string"


def brute(rows):
    out = set()
    seen = {}
    for r in rows:
        if r[0] is not None:
            seen[r[0]] = r
    for x, y in itertools.permutations(seen.values(), 2):
        s, t = ((v[1] or "").strip().lower() for v in (x, y))
        if s != "train" or t not in ("valid", "test") or x[3] is None or y[3] is None or abs(x[3] - y[3]) > 48 * 3600:
            continue
        gone = sum(u is None or v is None for u, v in zip(x[4:9], y[4:9]))
        if gone <= 1 and all(u is None or v is None or abs(u - v) <= f.tolerance * (1 + 1e-9) for u, v, f in zip(x[4:9], y[4:9], FIELDS)):
            out.add((min(x[0], y[0]), max(x[0], y[0])))
    return out


def test_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(260):
        base = rng.integers(0, 12)
        v = [0.3 * base + rng.normal(0, 0.008), 0.1 * base + rng.normal(0, 0.015), float(base % 3), 4 + rng.normal(0, 0.3), 2.5 + rng.normal(0, 0.006)]
        v = [None if rng.random() < 0.06 else float(x) for x in v]
        split = rng.choice(["train", "Train ", "test", " VALID", "other", None], p=[0.35, 0.15, 0.2, 0.2, 0.05, 0.05])
        at = None if rng.random() < 0.03 else float(rng.integers(0, 6 * 86400))
        rows.append((i, split, "s", at, *v, 0, "x"))
    rows += [rows[3], rows[4], (None, "train", "s", 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0, "x")]
    want = brute(rows)
    got = O.cross_split_pairs(spark.createDataFrame(rows, DDL), FIELDS).collect()
    assert len(want) > 30
    assert {(r["record_a"], r["record_b"]) for r in got} == want and len(got) == len(want)


def test_report_and_hot_group(spark):
    rows = [(i, "train" if i % 2 else "test", "lab" if i % 4 else None, 100.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0, "x") for i in range(60)]
    df = spark.createDataFrame(rows, DDL)
    pairs = O.cross_split_pairs(df, FIELDS)
    assert pairs.count() == 900
    report = {r["source"]: r for r in O.overlap_report(df, pairs).collect()}
    assert report["lab"]["records"] == report["lab"]["overlapping"] == 15 and report["lab"]["pairs"] == report["lab"]["exact_pairs"] == 450
    assert report[None]["pairs"] == 450


def test_empty(spark):
    df = spark.createDataFrame([], DDL)
    pairs = O.cross_split_pairs(df, FIELDS)
    assert pairs.count() == 0 and O.overlap_report(df, pairs).count() == 0


def test_texts_agree_in_canonical_form(spark):
    a = [(1, "train", "s", 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0, "The melt,  run No 4!"), (2, "test", "s", 10.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0, " the MELT run\u00a0no. 4"), (3, "valid", "s", 10.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0, "the melt run no 5"), (4, "valid", "s", 10.0, 1.004, 1.0, 1.0, 1.0, 1.0, 0, "the melt: run no 4")]
    got = O.cross_split_pairs(spark.createDataFrame(a, DDL), FIELDS, texts=("exact",)).collect()
    assert {(r["record_a"], r["record_b"], r["exact"]) for r in got} == {(1, 2, True), (1, 4, False)}
    assert [r[0] for r in spark.createDataFrame([("...",), (None,), ("A--b",)], "t string").select(O.canonical(O.F.col("t"))).collect()] == [None, None, "a b"]
