import hashlib

from helpers import empty, odd, small, texts

from tidelog.llm import op5_suffix_dedup as op5

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute(rows):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                w = b[p : p + 50]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49 if i is not None else 0):
            if least[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\x01" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, **kw):
    return sorted(map(tuple, op5.remove_repeats(df, **kw).select(*COLUMNS).collect()), key=str)


def test_small_table(spark):
    df = small(spark)
    want = brute(texts(df))
    assert sum(r[2] for r in want) > 0
    assert got(df.repartition(5)) == want
    assert got(df.repartition(3), keep_text=False, chunk_bytes=60_000) == want


def test_odd_rows(spark):
    df = odd(spark)
    assert got(df, chunk_bytes=8000) == brute(texts(df))


def test_many_buckets(spark, monkeypatch):
    """As many buckets as a large table gets; they hold about as much each."""
    df = small(spark)
    monkeypatch.setattr(op5, "BUCKET_BYTES", 64)
    assert got(df, chunk_bytes=50_000) == brute(texts(df))
    monkeypatch.undo()
    assert got(df, chunk_bytes=50_000, portion=3) == brute(texts(df))
    import numpy as np

    a = op5.Anchors(np.arange(300), [hashlib.sha256(bytes([i % 256, i // 256])).hexdigest().encode() * 40 for i in range(300)])
    n = np.bincount((a.h >> np.uint64(58)).astype(int), minlength=64)
    assert len(a.h) > 2000 and n.max() < 3 * n.mean()


def test_wide_groups(spark, monkeypatch):
    df = small(spark)
    held = op5.answer_entries
    monkeypatch.setattr(op5, "WIDE", 1)
    assert held is op5.answer_entries
    assert got(df, chunk_bytes=100_000) == brute(texts(df))


def test_wide_groups_in_the_workers(spark, monkeypatch):
    """With `wide` 0 the workers spread every asked gram: compare() gets nothing."""
    df = small(spark)
    held, kept = op5.save, []
    monkeypatch.setattr(op5, "save", lambda *a: kept.append(held(*a)) or kept[-1])
    assert got(df, chunk_bytes=100_000, wide=0) == brute(texts(df))
    assert kept[0].df.where("bucket < -1").count() > 0 and kept[0].df.where("bucket >= 0").count() == 0


def test_repeated_rows_in_several_chunks(spark):
    """Each row of a repeated id loses a passage that only partly fills its contexts."""
    words = [hashlib.sha256(bytes([i])).hexdigest() for i in range(40)]
    passage = words[0][:60]
    twice = (2, f"{words[1]} {passage} {words[2]}")
    rows = [(1, f"{words[3]} {passage} {words[4]}"), twice, *((10 + i, w * 3) for i, w in enumerate(words[5:])), twice]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    want = brute(rows)
    assert [r[2] for r in want if r[0] == 2] == [62, 62]
    assert got(df, chunk_bytes=200) == want


def test_empty(spark):
    assert got(empty(spark)) == []


def test_longest_previous_factor():
    text = b"abracadabra abracadabra"
    order = sorted(range(len(text)), key=lambda i: text[i:])

    def lcp(a, b):
        n = 0
        while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        return n

    lcps = [0, *(lcp(order[i - 1], order[i]) for i in range(1, len(order)))]
    import numpy as np

    assert op5.longest_previous(np.array(order), np.array(lcps)).tolist() == [max([0, *(lcp(j, i) for j in range(i))]) for i in range(len(text))]


def test_factors_decide():
    """Suffixes in and beyond runs of shared prefixes, against all pairs."""
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 60, 400):
        rows = np.zeros((n, 80), np.uint8)
        rows[:, :50] = rng.integers(0, 2, (n, 1)) + (rng.random((n, 50)) < 0.004)
        rows[:, 50:] = rng.integers(0, 2, (n, 30))
        doc = rng.integers(0, 30, n)
        order = np.lexsort((doc, *rows.T[::-1]))
        r, d = rows[order], doc[order]
        pairs = [[int((r[i] != r[j]).argmax()) if (r[i] != r[j]).any() else 80 for j in range(n)] for i in range(n)]
        want = np.array([max([0, *(pairs[i][j] for j in range(n) if d[j] < d[i])]) for i in range(n)], int)
        lcp = op5.neighbours_lcp(r) if n else np.zeros(0, int)
        assert op5.factors(d, lcp).tolist() == want.tolist()
        fifty = op5.factors(d, lcp, 50)
        assert np.array_equal(fifty >= 50, want >= 50) and np.array_equal(fifty[want >= 50], want[want >= 50])
        if n:
            assert np.array_equal(op5.copies(rows, doc)[order], want >= 50)
