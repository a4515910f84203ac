"""The stages of the pipeline, one by one and each on what the one before kept."""

import re
import zlib
from collections import defaultdict

import numpy as np
from helpers import odd, small
from test_op1_op3_op7_op9 import brute_contamination
from tokenizers import Tokenizer

import corpus_pipeline
from tidelog.llm import bpe

STAGES = dict(corpus_pipeline.STAGES)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def one_of_each(rows):
    sets, kept = [shingles(r["text"]) for r in rows], []
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i])
    for g in groups.values():
        kept.append(min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)))
    return kept


def without_repeats(rows):
    least, out = {}, []
    for r in rows:
        b = r["text"].encode()
        for p in range(len(b) - 49):
            least[b[p : p + 50]] = min(least.get(b[p : p + 50], r["doc_id"]), r["doc_id"])
    for r in rows:
        b = r["text"].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < r["doc_id"]:
                gone[p : p + 50] = b"\x01" * 50
        text = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if not any(gone) or text.strip():
            out.append(r | {"text": text, "n_chars": len(text)} if any(gone) else r)
    return out


def plain(df):
    return [r.asDict() for r in df.collect()]


def by_id(rows):
    return sorted(rows, key=lambda r: str(r["doc_id"]))


def test_stages(spark):
    docs = small(spark)
    at = "/root/testdata/sf0.001"
    extra = spark.createDataFrame([(9001, None, None, "s", 0), (9002, "123 !!", None, "s", 6), (9003, "", None, "s", 0)], docs.schema)
    docs = docs.union(extra)
    rows = plain(docs)
    rows = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    assert len(rows) == docs.count() - 3
    docs = spark.createDataFrame(plain(STAGES["language"](spark, docs, at)), docs.schema)
    assert by_id(plain(docs)) == by_id(rows)
    for name, brute in (("near_duplicates", one_of_each), ("repeated_text", without_repeats)):
        fewer = brute(rows)
        got = STAGES[name](spark, docs, at)
        assert got.columns == docs.columns
        docs = spark.createDataFrame(plain(got), docs.schema)
        assert by_id(plain(docs)) == by_id(fewer) and fewer != rows
        rows = fewer
    items = [(r["item_id"], r["text"]) for r in small(spark, "benchmark").collect()]
    hit = {d for d, _, n, _ in brute_contamination([(r["doc_id"], r["text"]) for r in rows], items) if n}
    docs = spark.createDataFrame(plain(STAGES["benchmark_leaks"](spark, docs, at)), docs.schema)
    rows = [r for r in rows if r["doc_id"] not in hit]
    assert hit and by_id(plain(docs)) == by_id(rows)
    tok = Tokenizer.from_file(bpe.default_path())
    ids = {r["doc_id"]: tok.encode(r["text"], add_special_tokens=False).ids + [0] for r in rows}
    pieces = plain(STAGES["sequences"](spark, docs, at))
    assert {p["doc_id"]: p["doc_tokens"] for p in pieces} == {d: len(x) for d, x in ids.items()}
    for p in pieces:
        own = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(own) == p["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == p["ids_crc32"]


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 100 and {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns)


def test_odd_rows_pass_every_stage(spark):
    docs = odd(spark).withColumnRenamed("extra", "lang").selectExpr("doc_id", "text", "cast(lang as string) lang", "chunk", "size", "key")
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, "/root/testdata/sf0.001").collect()
        assert rows
        if name != "sequences":
            docs = spark.createDataFrame(rows, docs.schema)


def test_language_decides_by_the_mixture(spark):
    docs = small(spark)
    rng = np.random.default_rng(3)
    noise = " ".join("".join(rng.choice(list("bcdfghjkqxzvwp"), 7)) for _ in range(60))
    extra = spark.createDataFrame([(9001, "Это русский текст для проверки", None, "s", 0), (9002, noise, None, "s", 0), (9003, "中文 文本 这是 一个 测试 文档", None, "s", 0)], docs.schema)
    got = STAGES["language"](spark, docs.union(extra), "/root/testdata/sf0.001")
    assert by_id(plain(got)) == by_id(plain(docs))


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "A clean text.", None), (2, "12 !", None), (3, None, None), (4, "né", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in STAGES["language"](spark, docs, "/root/testdata/sf0.001").collect()} == {1, 4}
