import numpy as np

from probloom.operators import impute as I
from probloom.schema import Feature

NUM = [Feature("x", "continuous", -50, 50), Feature("y", "continuous", -50, 50)]
CAT = [Feature("c", "categorical", codes=(0, 1))]
DDL = "id long, grp string, x double, y double, c int, z0 string, p0 int, __id int, r0 int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "u", 7, 8, 9) for r in rows], DDL)


def fill(df, targets=("x", "y", "c"), **kw):
    return I.fill_missing(df, "id", "grp", NUM, CAT, list(targets), **kw)


def test_fills_follow_group_and_class(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(1500):
        g, c = i % 3, int(rng.random() < 0.4)
        x = 10 * g + (8 if c else 0) + rng.normal(0, 1)
        rows.append([i, f"g{g}", x, -0.5 * x + rng.normal(0, 0.5), c])
    truth = [list(r) for r in rows]
    for i in range(0, 1500, 5):
        rows[i][2 + i // 5 % 3] = None
    rows[1][2], rows[2][3], rows[3][4] = float("nan"), 1e6, 7  # NaN, out of range, unknown code
    df = frame(spark, [*rows, rows[0]])
    out = {r["id"]: r for r in fill(df, components=4).collect()}
    assert len(out) == 1500
    err, right = [], []
    for i, (r, t) in enumerate(zip(rows, truth)):
        o = out[i]
        assert (o["z0"], o["p0"], o["__id"], o["r0"]) == ("u", 7, 8, 9)
        for j, name in enumerate(("x", "y", "c")):
            v = r[2 + j]
            gone = v is None or v != v or (name != "c" and abs(v) > 50) or (name == "c" and v not in (0, 1))
            assert o[f"{name}_filled"] == gone
            if gone and name == "c":
                right.append(o["c"] == t[4])
            elif gone:
                assert -50 <= o[name] <= 50
                err.append(o[name] - t[2 + j])
            else:
                assert o[name] == v
    assert np.sqrt(np.mean(np.square(err))) < 2.0 and np.mean(right) > 0.95


def test_edges(spark):
    assert fill(frame(spark, [])).count() == 0
    rows = [(1, None, None, None, None), (2, "a", 3.0, None, 1), (None, "a", None, 2.0, None), (None, "b", 1.0, 2.0, 0)]
    out = fill(frame(spark, rows), decimals={"x": 0}).collect()
    assert len(out) == 3 and all(r["x"] is not None and r["y"] is not None and r["c"] in (0, 1) for r in out)
    nothing = fill(frame(spark, [(i, "a", None, None, None) for i in range(5)])).collect()
    assert all(r["x"] == 0 and r["y"] == 0 and r["c"] in (0, 1) for r in nothing)


def test_em_raises_the_likelihood():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(-2, 1, (200, 2)), rng.normal(3, 1, (200, 2))])
    x[rng.random(x.shape) < 0.2] = np.nan
    c = np.full((400, 0), -1)
    m, last = I.start(x[:50], c[:50], [], 2), -np.inf
    for _ in range(10):
        s = I.statistics(m, x, c)
        assert s[0] > last - 1.0  # the weak prior may cost a little
        last, m = s[0], I.updated(m, s)


def test_statistics_equal_row_by_row_expectations():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (60, 3))
    x[rng.random(x.shape) < 0.3] = np.nan
    cats = rng.integers(-1, 2, (60, 1))
    root = rng.normal(0, 1, (2, 3, 3))
    m = I.Mixture(np.array([0.3, 0.7]), rng.normal(0, 1, (2, 3)), root @ root.transpose(0, 2, 1) + np.eye(3), [np.array([[0.2, 0.8], [0.6, 0.4]])])
    got = I.statistics(m, x, cats)
    ll, w, first, second, filled = 0.0, np.zeros(2), np.zeros((2, 3)), np.zeros((2, 3, 3)), []
    for v, c in zip(x, cats[:, 0]):
        o, u = np.nonzero(~np.isnan(v))[0], np.nonzero(np.isnan(v))[0]
        p, mean, cov = np.zeros(2), [], []
        for j in range(2):
            s = m.covs[j][np.ix_(o, o)]
            off = v[o] - m.means[j, o]
            p[j] = m.weights[j] * np.exp(-0.5 * off @ np.linalg.solve(s, off)) / np.sqrt(np.linalg.det(2 * np.pi * s)) * (m.tables[0][j, c] if c >= 0 else 1)
            full, rest, g = v.copy(), np.zeros((3, 3)), m.covs[j][np.ix_(u, o)] @ np.linalg.inv(s)
            full[u] = m.means[j, u] + g @ off
            rest[np.ix_(u, u)] = m.covs[j][np.ix_(u, u)] - g @ m.covs[j][np.ix_(o, u)]
            mean.append(full)
            cov.append(rest)
        ll += np.log(p.sum())
        p /= p.sum()
        filled.append(sum(p[j] * mean[j] for j in range(2)))
        for j in range(2):
            w[j] += p[j]
            first[j] += p[j] * (mean[j] - m.means[j])
            second[j] += p[j] * (np.outer(mean[j] - m.means[j], mean[j] - m.means[j]) + cov[j])
    assert np.allclose(got[:4], [ll, 60, *w]) and np.allclose(got[4:10], first.ravel()) and np.allclose(got[10:28], second.ravel())
    lj, patterns = I.log_joint(m, x, cats)
    assert np.allclose(I.expected(m, x, I.responsibilities(lj)[0], patterns), filled)


def test_many_groups_are_joined_with_salts(spark, monkeypatch):
    from probloom import runtime

    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(runtime, "SALT_ROWS", 40)
    rows = [(i, f"g{i % 7}" if i % 5 else None, float(i % 9), None if i % 4 == 0 else float(i % 3), i % 2) for i in range(300)]
    out = fill(frame(spark, rows)).collect()
    assert len(out) == 300 and all(r["y"] is not None for r in out)
