import collections

from probloom.llm import mixing as X

ITEMS = "doc_id long, source string, size long, pass int, block int"
PLANS = "plan_no long, source string, target_share double, max_repeats int, size_factor double, source_tokens int"


def run(spark, items, plans, block=16):
    a = spark.createDataFrame([(*x, 0, 0) for x in items], ITEMS)
    b = spark.createDataFrame([(*x, 0) for x in plans], PLANS)
    return a, b, X.mix(a, b, block)


def test_shares_caps_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(X, "SHARD_SLOTS", 20)
    items = [(i, "big", 37 + i % 5) for i in range(200)] + [(1000 + i, "small", 50) for i in range(4)] + [(2000, "tiny", 3), (3000, None, 500), (3001, "big", 0)]
    plans = [(1, "big", 0.5, 1, 0.5), (1, "small", 0.3, 3, 0.5), (1, "tiny", 0.1, 2, 0.5), (1, "absent", 0.1, 2, 0.5), (2, "big", 1.0, 3, 2.0)]
    a, b, mixed = run(spark, items, plans)
    rows = mixed.collect()
    total = sum(n for _, s, n in items if s)
    used = collections.Counter()
    touched = collections.Counter()
    length = collections.Counter()
    for r in rows:
        used[r["plan_no"], r["source"]] += r["end"] - r["start"]
        length[r["plan_no"], r["slot"]] += r["end"] - r["start"]
        for t in range(r["start"], r["end"]):
            touched[r["plan_no"], r["doc_id"], t] += 1
    big, small = sum(n for _, s, n in items if s == "big"), 200
    assert used[1, "big"] == round(0.25 * total) and used[1, "small"] == 3 * small and used[1, "tiny"] == 6
    assert used[2, "big"] == min(round(2.0 * total), 3 * big)
    assert max(length.values()) <= 16
    caps = {"big": {1: 1, 2: 3}, "small": {1: 3}, "tiny": {1: 2}}
    source = {i: s for i, s, _ in items}
    assert all(n <= caps[source[d]][p] for (p, d, _), n in touched.items())
    report = {(r["plan_no"], r["source"]): r for r in X.mix_report(a, b, mixed).collect()}
    assert report[1, "small"]["short"] and report[1, "absent"]["short"] and not report[1, "big"]["short"]
    assert abs(sum(r["actual_share"] for k, r in report.items() if k[0] == 1) - 1) < 1e-5


def test_slots():
    assert X.slots_of(33, 20, 8) == 3 + 2 and X.slots_of(0, 20, 8) == 0 and X.slots_of(5, 0, 8) == 0


def test_empty(spark):
    assert run(spark, [], [(1, "a", 1.0, 1, 1.0)])[2].count() == 0
    assert run(spark, [(1, "a", 5)], [])[2].count() == 0


def test_draws_keep_the_quotas_at_any_length(monkeypatch):
    import numpy as np

    for slots in ([3, 0, 5], [700, 200, 100], [8192 * 30 + 5, 77, 8192 * 40]):
        monkeypatch.setattr(X, "BOOK", 1 << 28 if slots[0] < 1000 else 1 << 18)
        books, length, seen = X.books_of(slots), X.shard_length(sum(slots)), np.zeros(len(slots), int)
        for b, (first, counts) in enumerate(books):
            assert list(seen) == first
            n = -(-sum(counts) // length)
            shards = list(X.shard_counts(np.array(counts), length, n, range(n), [1, b]))
            for i, before, own in shards:
                assert list(before + first) == list(seen) and own.sum() == min(length, sum(counts) - i * length)
                seen = seen + own
            some = list(X.shard_counts(np.array(counts), length, n, range(n // 2, n), [1, b]))
            assert [list(x[2]) for x in some] == [list(x[2]) for x in shards[n // 2 :]]  # the same from any task
        assert list(seen) == slots
    shares = [own[0] / own.sum() for _, _, own in shards if own.sum() == length]
    assert np.std(shares) > 0 and abs(np.mean(shares) - counts[0] / sum(counts)) < 0.02  # drawn, not dealt evenly


def test_slots_number_the_blocks_of_a_plan_and_sources_alternate(spark):
    items = [(i, "a", 50) for i in range(400)] + [(1000 + i, "b", 30) for i in range(700)]
    rows = run(spark, items, [(1, "a", 0.5, 1, 1.0), (1, "b", 0.5, 2, 1.0)])[2].collect()
    source = {r["slot"]: r["source"] for r in rows}
    assert sorted(source) == list(range(len(source)))
    turns = sum(source[i] != source[i + 1] for i in range(len(source) - 1))
    assert turns > len(source) / 4


def test_found_runs_the_mix(spark, monkeypatch):
    from probloom.llm import registry

    items = [(i, "a", 50) for i in range(40)] + [(100 + i, "b", 30) for i in range(20)]
    a, b, mixed = run(spark, items, [(1, "a", 0.5, 1, 1.0), (1, "b", 0.5, 2, 1.0)])
    assert mixed.select("shard").distinct().count() > 32  # the plan is drawn, however small
    calls, own = [], X.mix
    monkeypatch.setattr(X, "mix", lambda *x: calls.append(1) or own(*x))
    monkeypatch.setattr(registry, "table", lambda s, d, n: a if n == "documents" else b)
    monkeypatch.setattr(registry.tokens, "sized_documents", lambda d: d)
    assert [tuple(r) for r in registry.p7_found(spark, "").collect()] == [(1, "b")] and calls == [1]
