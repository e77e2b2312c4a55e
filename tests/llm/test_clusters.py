import numpy as np

from probloom.llm import clusters as C
from probloom.schema import Feature

FIELDS = [Feature("p", "continuous", step=1.0), Feature("q", "continuous", step=0.5), Feature("r", "continuous", step=2.0), Feature("s", "continuous", step=1.0)]
DDL = "record_id long, p double, q double, r double, s double, cluster_id int, z0 string, k0 string, n int, g int"


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i) if i is not None else None, *[None if v is None else float(v) for v in r], 0, "z", "k", 1, 2) for i, r in zip(ids, x)], DDL)


def brute(x):
    z = x / np.array([1.0, 0.5, 2.0, 1.0])
    label, c = np.full(len(z), -1), 0
    for i in range(len(z)):
        if label[i] < 0:
            queue, label[i] = [i], c
            while queue:
                j = queue.pop()
                for k in np.nonzero((label < 0) & (((z - z[j]) ** 2).sum(1) <= 1 + 1e-9))[0]:
                    label[k] = c
                    queue.append(k)
            c += 1
    return label


def same(got, label):
    pairs = {(a, b) for a, b in zip(got, label)}
    return len(pairs) == len(set(got)) == len(set(label))


def check(spark, x):
    got = {r["record_id"]: r["cluster_id"] for r in C.similarity_clusters(frame(spark, x), FIELDS).select("record_id", "cluster_id").collect()}
    assert len(got) == len(x)
    assert same([got[i] for i in range(len(x))], brute(x))


def test_random_points_and_gaps_near_the_threshold(spark):
    rng = np.random.default_rng(2)
    scale = np.array([1.0, 0.5, 2.0, 1.0])
    loose = rng.uniform(0, 7, (220, 4)) * scale
    dense = rng.normal(0, 0.4, (120, 4)) * scale
    chain = np.stack([np.arange(12) * 0.97, np.zeros(12), np.zeros(12), np.full(12, 30.0)], 1) * scale  # rising chain
    gap = np.stack([20 + np.array([0, 0.9, 1.95, 2.9]), np.zeros(4), np.zeros(4), np.zeros(4)], 1) * scale  # 1.05 apart in the middle
    check(spark, np.vstack([loose, dense, chain, gap]))


def test_missing_copies_strays_and_description(spark):
    rows = [(0, 0, 0, 0)] * 6 + [(50, 0, 0, 0), (None, 0, 0, 0), (0, None, 0, 0)]
    df = frame(spark, rows + [(0, 0, 0, 0)], list(range(9)) + [0])  # id 0 is delivered twice
    members = C.similarity_clusters(df, FIELDS)
    out = {r["size"]: r for r in C.describe_clusters(members, FIELDS).collect()}
    assert set(out) == {6, 1} and out[1]["stray"] and not out[6]["stray"] and list(out[6]["typical_ids"]) == [0, 1, 2]


def test_empty(spark):
    assert C.similarity_clusters(frame(spark, []), FIELDS).count() == 0


def test_long_rising_chains_end_in_few_rounds(spark, monkeypatch):
    # Gaps grow along the chain, so that a round of mutual pairs alone would merge one pair.
    n = 300
    x = np.zeros((n, 4))
    x[:, 0] = np.cumsum(np.linspace(0.55, 0.999, n))
    rounds, own = [], C._roots
    monkeypatch.setattr(C, "_roots", lambda p, label: rounds.append(1) or own(p, label))
    check(spark, x)
    assert len(rounds) < 12


def test_dense_boxes_near_the_threshold_are_halved(spark):
    rng = np.random.default_rng(6)
    scale = np.array([1.0, 0.5, 2.0, 1.0])
    for gap in (1.0001, 0.9999):
        a, b = rng.uniform(0, 0.05, (300, 4)), rng.uniform(0, 0.05, (300, 4))
        a[:, 0], b[:, 0] = -a[:, 0], b[:, 0] + gap
        a[0], b[0] = 0, [gap, 0, 0, 0]  # the only pair so near
        a[1:, 0] -= 0.01
        check(spark, np.vstack([a, b]) * scale + 7)
