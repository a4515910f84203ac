import re

import numpy as np
import pytest
from helpers import empty, odd, small, texts

from tidelog.llm import op6_jaccard_join as op6


def shingles(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return frozenset(tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))) if w else frozenset()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if sets[i] and percent * len(sets[j]) <= 100 * len(sets[i]):
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 400, 300)]
    rows = []
    for i in range(700):
        w = list(base if i % 2 else base[:120])
        for p in rng.integers(0, len(w), rng.integers(0, 9)):
            w[p] = f"e{rng.integers(0, 1000)}"
        rows.append((i, " ".join(w)))
    common = " ".join(f"p{i}" for i in range(60))
    rows += [(1000 + i, " ".join(f"u{i}x{k}" for k in range(rng.integers(20, 200))) + " " + common) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def common_lines(spark):
    """Documents made wholly of lines that many documents share: cells that no rare shingle thins out."""
    rng = np.random.default_rng(4)
    lines = [" ".join(f"l{k}w{i}" for i in range(12)) for k in range(14)]
    rows = [(i, " ".join(lines[k] for k in rng.permutation(14)[: rng.integers(5, 14)])) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("table", ["small", "odd", "near", "lines", "empty"])
@pytest.mark.parametrize("leaf", [256, 16])
def test_components(spark, table, leaf):
    df = {"small": small, "odd": odd, "near": near_copies, "lines": common_lines, "empty": empty}[table](spark)
    got = op6.jaccard_components(df, percent=85, shingle=4, chunk_bytes=300_000, leaf=leaf)
    assert sorted(map(tuple, got.collect()), key=str) == brute(texts(df))


def test_cells_cut_by_size(spark, monkeypatch):
    df = common_lines(spark)
    monkeypatch.setattr(op6, "DEPTH", 0)  # no pivots: every large cell is cut by size
    got = op6.jaccard_components(df, percent=85, shingle=4, leaf=16)
    assert sorted(map(tuple, got.collect()), key=str) == brute(texts(df))


def test_shared_passage_is_no_cell(spark):
    """One passage in every document, each with enough words of its own: no cell holds two."""
    common = " ".join(f"p{i}" for i in range(60))
    rows = [(i, common + " " + " ".join(f"u{i}x{k}" for k in range(40))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = op6.jaccard_components(df, percent=85, shingle=4).where("doc_id = component_id")
    assert got.count() == 3000


def test_region_pairs():
    rng = np.random.default_rng(5)
    heads = rng.poisson(8, (30, 64))
    x = np.concatenate([rng.poisson(rng.choice([3, 8, 20]), 64)[None] for _ in range(400)] + [np.maximum(heads[rng.integers(0, 30, 600)] + rng.integers(-1, 2, (600, 64)) * (rng.random((600, 64)) < 0.2), 0)])
    size = x.sum(1)
    label = rng.integers(0, 500, len(x))
    i, j, d = op6.region_pairs(x.astype(np.uint8), size, size, label, 85)
    l1 = np.abs(x[:, None, :].astype(np.int16) - x[None, :, :]).sum(2)
    a, b = np.nonzero(op6.allowed(size[:, None], size[None, :], l1, 85) & (label[:, None] != label[None, :]))
    assert {*zip(i.tolist(), j.tolist())} == {(p, q) for p, q in zip(a.tolist(), b.tolist()) if p < q}
    assert (d == l1[i, j]).all()
    pick = op6.spanning_forest(i, j, d, np.arange(len(x)))
    assert len(pick) <= len(x) - 1
