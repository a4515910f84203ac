import numpy as np
import pytest

from tidelog.llm import op10_embedding_dedup as op10


def brute(rows, threshold):
    good = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {k: set() for k in range(len(rows))}
    for k, _, a in good:
        for m, _, b in good:
            if k != m and len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                near[k].add(m)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        out.append((i, len(near[k]), min(rows[m][0] for m in seen)))
    return sorted(out)


def made(seed, n=300, dims=16):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(20, dims))
    x = np.concatenate([rng.normal(size=(n, dims)), heads[rng.integers(0, 20, n)] + rng.normal(size=(n, dims)) * rng.choice([0.05, 0.2, 0.35], (n, 1))])
    x[5] = x[6] = x[n + 3]
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    rows += [(2 * n, None), (2 * n + 1, [0.0] * dims), (2 * n + 2, [float("nan")] * dims), (2 * n + 3, [None] * dims), (2 * n + 4, []), (2 * n + 5, [1.0, 2.0]), (2 * n + 6, [2.0, 4.0]), (2 * n + 7, [-x for x in rows[0][1]]), (2 * n + 7, rows[0][1])]
    return rows


@pytest.mark.parametrize("group", [6144, 40])
def test_against_all_pairs(spark, group):
    rows = made(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    for clash in ("uid", "vec", "node", "copies", "g", "far", "part", "pair"):
        df = df.withColumn(clash, df.vec_id)
    got = sorted(map(tuple, op10.near_duplicates(df, 0.9, group=group).collect()))
    assert got == brute(rows, 0.9)
    assert sum(r[1] for r in got) > 100


def test_extreme_norms(spark):
    """Norms whose squares overflow or vanish in double precision."""
    a, b = [3.0, 4.0, 0.0], [0.0, 4.0, 3.0]
    rows = [(k, [x * s for x in v]) for k, (v, s) in enumerate([(a, 1.0), (a, 1e200), (a, 1e-200), (b, 1e250), (b, 1e-250), (b, -1e200), (a, 5e-324)])]
    got = sorted(map(tuple, op10.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == [(0, 3, 0), (1, 3, 0), (2, 3, 0), (3, 1, 3), (4, 1, 3), (5, 0, 5), (6, 3, 0)]


@pytest.mark.parametrize("group", [6144, 100])
def test_dense_group(spark, group):
    """A third of all rows in one ball: counted whole, not pair by pair."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(1, 8)) + rng.normal(size=(400, 8)) * 0.01, rng.normal(size=(300, 8)), np.tile(rng.normal(size=(1, 8)), (50, 1))])
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got = sorted(map(tuple, op10.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), group=group).collect()))
    assert got == brute(rows, 0.95)


def test_dual_traversal_alone():
    x = op10.unit_rows(np.array([v for _, v in made(2)[:600]]))
    t = op10.CoverTree(x)
    got = {(min(i, j), max(i, j)) for a, b in op10.dual_pairs(t, t, x, x, 0.85, True) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if x[i] @ x[j] >= 0.85}
    assert got == want


def test_cover_tree():
    """Nested, separated and covering: what the bounds rest on."""
    x = op10.unit_rows(np.array([v for _, v in made(3)[:600]]))
    t = op10.CoverTree(x)
    assert sorted(t.order.tolist()) == list(range(600))
    for k in range(len(t.centre)):
        members = t.order[t.lo[k] : t.hi[k]]
        assert t.centre[k] in members and (op10.chord(x[members] @ x[t.centre[k]]) <= t.radius[k] + 1e-7).all()
        kids = np.arange(t.kid_lo[k], t.kid_hi[k])
        if len(kids):
            assert t.centre[k] in t.centre[kids] and (t.hi - t.lo)[kids].sum() == len(members)
            c = op10.chord(x[t.centre[kids]] @ x[t.centre[kids]].T) + 9 * np.eye(len(kids))
            assert c.min() > t.radius[kids].max() - 1e-3


def test_empty_and_bad_only(spark):
    assert op10.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    rows = [(1, None), (2, [0.0]), (2, [float("inf")])]
    assert sorted(map(tuple, op10.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]
