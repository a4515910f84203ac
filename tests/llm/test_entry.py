"""Every registered query: its columns and types, and its rows against the library or brute force."""

import zlib

import numpy as np
import pytest
from helpers import SMALL, small, texts
from test_op4 import brute as known_sentences
from tokenizers import Tokenizer

from tidelog.llm import entry, op4_licenses
from tidelog.llm.licences import RULES

FIRST = {
    "op1_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op2_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op3_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_licenses": "doc_id bigint, licenses string, category string, n_sentences bigint, n_unknown bigint",
    "op5_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op6_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op7_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op8_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op9_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op10_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "pipeline": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
}


@pytest.fixture(scope="module")
def results(spark):
    made = {}

    def get(name):
        if name not in made:
            df = entry.queries()[name](spark, SMALL)
            made[name] = df.dtypes, [r.asDict() for r in df.collect()]
        return made[name]

    return get


@pytest.fixture(scope="module")
def ids(spark):
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in texts(small(spark))}


def crc(some):
    return zlib.crc32(np.array(some, "<u4").tobytes())


@pytest.mark.parametrize("name", FIRST)
def test_columns(spark, results, name):
    kinds, rows = results(name)
    want = [tuple(c.split()) for c in FIRST[name].split(", ")]
    assert kinds[: len(want)] == want
    if name not in ("op2_packing", "op10_embedding_dedup", "pipeline"):
        assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in texts(small(spark)))


def test_token_counts(spark, results, ids):
    want = {i: (len((t or "").encode()), len(ids[i]), len(ids[i]) > 512) for i, t in texts(small(spark))}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in results("op1_token_counts")[1]} == want
    assert {x[2] for x in want.values()} == {True, False}


def test_packing(results, ids):
    rows = results("op2_packing")[1]
    own, room = {}, {}
    for r in rows:
        whole = [*ids[r["doc_id"]], 0]
        assert r["doc_tokens"] == len(whole) and r["ids_crc32"] == crc(whole[r["start"] : r["start"] + r["length"]])
        own.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert own.keys() == ids.keys()
    for spans, n in [*((own[i], len(ids[i]) + 1) for i in own), *((s, None) for s in room.values())]:
        spans.sort()
        ends = [lo + n for lo, n in spans]
        assert [lo for lo, _ in spans] == [0, *ends[:-1]] and (ends[-1] == n if n else ends[-1] <= 1024)
    assert len(room) == -(-sum(len(x) + 1 for x in ids.values()) // 1024)


def test_language(spark, results):
    rows = results("op3_language")[1]
    lang = {r["doc_id"]: r["lang"] for r in small(spark).collect()}
    learnt = {v for k, v in lang.items() if v and zlib.crc32(str(k).encode()) % 3 != 1}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["lang_pred"] in learnt | {"und"}
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.95 * len(held)


def test_licenses(spark, results):
    """Sentences from every stretch of a text, and the rules tried one after the other."""
    got = {r["doc_id"]: r for r in results("op4_licenses")[1]}
    for i, t in texts(small(spark)):
        if t and len(t) < 4000:
            names, found = known_sentences(t), set()
            while names:
                licence, ids = next(((x, k) for x, k in [*RULES, *((n.removeprefix("notice:"), [n]) for n in names)] if names[: len(k)] == k), (None, [0]))
                found |= {licence} - {None}
                names = names[len(ids) :]
            assert got[i]["licenses"] == ",".join(sorted(found)) and got[i]["n_sentences"] == len(known_sentences(t))
    assert op4_licenses.scan_licenses(small(spark)).count() == len(got)


def test_token_files(results, ids):
    at = 0
    for r in sorted(results("op8_token_files")[1], key=lambda r: r["doc_id"]):
        whole = [*ids[r["doc_id"]], 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(whole), crc(whole))
        at += len(whole)


def test_sharding(spark, results):
    rows = results("op9_sharding")[1]
    text = dict(texts(small(spark)))
    total, most = sum(len((t or "").encode()) + 1 for t in text.values()), max(len((t or "").encode()) + 1 for t in text.values())
    for s in range(16):
        own = sorted((r for r in rows if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own))) and abs(sum(r["size"] for r in own) - total / 16) <= most
        assert [r["doc_id"] for r in own] == sorted(r["doc_id"] for r in own)
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)


def test_pipeline_pieces(results, ids):
    rows = results("pipeline")[1]
    assert 100 < len({r["doc_id"] for r in rows}) < len(ids) and max(r["offset"] + r["length"] for r in rows) <= 1024
