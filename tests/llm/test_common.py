import numpy as np
import pytest

from tidelog.llm import common


def brute(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def graphs():
    rng = np.random.default_rng(7)
    yield [(i, i + 1) for i in range(60)]
    yield [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2)) if a != b]
    yield [(0, i) for i in range(1, 50)] + [(200 - i, i) for i in range(1, 50, 7)] + [(500, 501)]
    yield []


@pytest.mark.parametrize("links", [1 << 20, 20])
@pytest.mark.parametrize("edges", list(graphs()))
def test_components(spark, monkeypatch, edges, links):
    monkeypatch.setattr(common, "LINKS", links)  # few to a task: rounds between tasks, too
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["component"] for r in common.components(df, "t").collect()} == brute(edges)


def test_local_forest():
    for edges in graphs():
        a, b = np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64)
        v, root = common.local_forest(a, b)
        want = {x: r for x, r in brute(edges).items() if x != r}
        assert dict(zip(v.tolist(), root.tolist())) == want


def test_pack_round_trip():
    arrays = [np.arange(5, dtype=np.uint64) * 2**60, np.array([-1, 2, 3, 4, 5], np.int64), np.array([1, 2, 3, 4, 255], np.uint8)]
    for n in (5, 0):
        got = common.unpack(common.pack(*(a[:n] for a in arrays)))
        assert all((x == a[:n]).all() and x.dtype == a.dtype for x, a in zip(got, arrays))
