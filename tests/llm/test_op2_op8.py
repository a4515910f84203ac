import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import empty, odd, small, texts
from tokenizers import Tokenizer

from tidelog.llm import bpe, op2_packing, op8_token_files


def encoded(rows):
    tok = Tokenizer.from_file(bpe.default_path())
    return [(i, tok.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(df, capacity):
    rows = op2_packing.pack_sequences(df, capacity=capacity, with_ids=True).collect()
    want = sorted((str(i), len(ids), crc(ids)) for i, ids in encoded(texts(df)))
    docs, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == crc(r["ids"])
        docs[str(r["doc_id"]), r["doc_tokens"]].append(r)
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in fill.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    assert sum(sum(n for _, n in s) == capacity for s in fill.values()) >= len(fill) - 1
    got = []
    for (i, n), pieces in docs.items():
        pieces.sort(key=lambda r: (r["start"], r["sequence_id"]))
        copies = sum(p["start"] == 0 for p in pieces)
        if copies == 1:
            ids = [x for p in pieces for x in p["ids"]]
            assert [p["start"] for p in pieces] == list(np.cumsum([0, *(p["length"] for p in pieces)])[:-1])
            got.append((i, len(ids), crc(ids)))
    assert {*got} == {w for w in want if want.count(w) == 1}


def test_packing(spark):
    check_packing(small(spark), 1024)
    check_packing(odd(spark), 64)
    assert op2_packing.pack_sequences(empty(spark)).count() == 0


def test_hilbert_steps_are_neighbours():
    x = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = op2_packing.hilbert(x, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = x[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("planes", [4, 32])
def test_file_round_trip(planes):
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 2**32, 5000, dtype=np.uint32)
    ids[:3000] %= 300
    content = op8_token_files.encode_file([7, None], [4000, 1000], ids, planes, block=1024)
    f = op8_token_files.TokenFile(content)
    assert f.doc_ids == [7, None] and f.lengths.tolist() == [4000, 1000]
    assert (f.read(0, 5000) == ids).all() and (f.read(1000, 3100) == ids[1000:3100]).all()


@pytest.mark.parametrize("table", ["small", "odd", "empty"])
def test_token_files(spark, tmp_path, table):
    df = {"small": small, "odd": odd, "empty": empty}[table](spark)
    op8_token_files.write_token_files(df.repartition(3), f"file://{tmp_path}/f", file_ids=20_000)
    rows = op8_token_files.read_documents(spark, f"file://{tmp_path}/f", with_ids=True).collect()
    want, at = [], 0
    for i, ids in sorted(encoded(texts(df)), key=lambda x: (x[0] is not None, x[0] or 0)):
        want.append((i, at, len(ids), crc(ids), ids))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
