import re
import zlib

import pytest
from helpers import empty, odd, small, texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm import bpe, op1_token_counts, op3_language, op7_decontamination, op9_sharding

TABLES = {"small": small, "odd": odd, "empty": empty}


@pytest.mark.parametrize("table", TABLES)
def test_token_counts(spark, table):
    df = TABLES[table](spark)
    tok = Tokenizer.from_file(bpe.default_path())
    want = []
    for i, t in texts(df):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert sorted(map(tuple, op1_token_counts.token_counts(df).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a ", "a\nb", "a \nb", "a\n b", "\n\na  b", "it's  don't x", "x y z", "1 2\t3", "<|endoftext|> a", "中 文 x", "é é ½ ²", "a\x1cb c\x85 d", "*** $$$ a*** ..", "\r\n a\r\nb"])
def test_pieces_equal_the_whole(text):
    b = bpe.Bpe(bpe.default_path(), limit=3)
    whole = b.encode_whole(text)
    assert [int.from_bytes(x[i : i + 4], "little") for x in b.id_bytes([text]) for i in range(0, len(x), 4)] == whole
    assert b.n_tokens([text]) == [len(whole)]


def test_language(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op3_language.train(df.where(~op3_language.held_out("doc_id")))
    got = op3_language.identify(df, model).where(op3_language.held_out("doc_id") & F.col("lang").isNotNull())
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("long")), F.count("*")).first()
    assert n > 250 and right / n > 0.97
    mixed = [t for (t,) in df.where("lang in ('en', 'fr') and n_chars between 800 and 3000").orderBy("lang", "doc_id").select("text").collect()]
    shares = model.predict(mixed[0] + " " + mixed[-1])[2]
    assert {"en", "fr"} <= shares.keys() and abs(sum(shares.values()) - 1) < 1e-6


def test_language_odd(spark):
    df = small(spark)
    model = op3_language.train(df)
    got = {r["doc_id"]: r for r in op3_language.identify(odd(spark), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in {*model.langs, "und"} for r in got.values())
    none = op3_language.train(df.where("false"))
    assert {r["lang_pred"] for r in op3_language.identify(df, none).collect()} == {"und"}
    assert op3_language.identify(empty(spark), model).count() == 0


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute_contamination(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None:
            for k in range(max(len(w) - 9, 1) if w else 0):
                windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) and n:
                    hit |= {*range(k, k + n)}
                    found |= own
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("table", TABLES)
@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_contamination(spark, table, broadcast):
    df = TABLES[table](spark)
    extra = spark.createDataFrame([(900, "lang1 text1"), (901, "SHORT"), (902, None), (None, "short"), (903, "..."), (901, "SHORT"), (904, "word3 of passage word4 of passage word5 of passage word6 of passage")], "item_id long, text string")
    items = small(spark, "benchmark").unionByName(extra)
    cols = ["doc_id", "n_words", "n_hit", "items"]
    got = op7_decontamination.contamination(df, items, broadcast_bytes=broadcast).select(*cols)
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    assert sorted(map(tuple, got.collect()), key=str) == brute_contamination(texts(df), rows)
    assert sorted(map(tuple, op7_decontamination.contamination(df, items.where("false"), broadcast_bytes=broadcast).select(*cols).collect()), key=str) == brute_contamination(texts(df), [])


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_contamination_with_common_windows(spark, broadcast):
    """A short item and a window that every document holds; own names among the columns."""
    rows = [(i, f"common phrase here {'x ' * (i % 5)}" + " ".join(f"w{k}" for k in range(i % 3, 14))) for i in range(300)]
    items = [(1, "common phrase"), (2, " ".join(f"w{k}" for k in range(14))), (3, "never seen"), (4, "COMMON")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for clash in ("_key", "_row", "key", "print", "window", "hit", "held", "_hit", "_held", "item", "near"):
        df = df.withColumn(clash, F.lit(7))
    got = op7_decontamination.contamination(df, spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=broadcast)
    assert {*df.columns} < {*got.columns}
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_hit", "items").collect()), key=str) == brute_contamination(rows, items)


def test_other_tokenizers(spark):
    """A tokenizer whose pre-tokens are not known to start at the cuts gets whole texts."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    df = small(spark)
    want = sorted((i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in texts(df))
    assert sorted((r["doc_id"], r["n_tokens"]) for r in op1_token_counts.token_counts(df, tokenizer=path).collect()) == want
    assert bpe.cuts_hold(Tokenizer.from_file(bpe.default_path())) and not bpe.cuts_hold(tok)


def test_caches_stay_in_their_bounds():
    b = bpe.Bpe(bpe.default_path(), limit=100)
    whole = [b.encode_whole(f"word{i} other{i}  two") for i in range(500)]
    for k in range(0, 500, 50):
        some = [f"word{i} other{i}  two" for i in range(k, k + 50)]
        assert b.n_tokens(some) == [len(x) for x in whole[k : k + 50]]
        assert [len(x) // 4 for x in b.id_bytes(some)] == [len(x) for x in whole[k : k + 50]]
        assert all(len(getattr(b, n)) <= b.limit for n in ("ids", "counts", "odd"))


def test_letters():
    """Text without a letter (Unicode category L) is `und`, whatever numbers it holds."""
    import unicodedata

    assert [op3_language.letters(t) for t in ("½²¾", "Ⅳ", "12", "_", "x²y", "Né3à")] == ["", "", "", "", " x y ", " né à "]
    assert all(bool(op3_language.letters(c)) == (unicodedata.category(c)[0] == "L") for c in map(chr, range(0x20, 0x3000)))


def test_held_out_without_an_id(spark):
    rows = spark.createDataFrame([(None,), (1,), (2,), (3,), (4,)], "doc_id long").select("doc_id", op3_language.held_out("doc_id").alias("h")).collect()
    assert [(r["doc_id"], r["h"]) for r in rows] == [(i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i in (None, 1, 2, 3, 4)]


@pytest.mark.parametrize("table", TABLES)
def test_shards(spark, table):
    df = TABLES[table](spark)
    rows = op9_sharding.byte_shards(df, shards=16).collect()
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts(df))
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    if rows:
        total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
        for s in {r["shard"] for r in rows}:
            own = sorted((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0) for r in rows if r["shard"] == s)
            assert [x[0] for x in own] == list(range(len(own))) and [x[1:] for x in own] == sorted(x[1:] for x in own)
            assert abs(sum(r["size"] for r in rows if r["shard"] == s) - total / 16) <= most
