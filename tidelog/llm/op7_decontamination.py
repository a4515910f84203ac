"""Benchmark decontamination by winnowing.

Of every window of ten words, the least of its six 5-gram hashes is a fingerprint, on both
sides; so a document and a benchmark item that share ten words in a row share the
fingerprint of that window.  Shared fingerprints are extended to the windows around them
and kept where all ten words are the same.  Items of fewer than ten words are one window
of their own length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import claim, save, slices, text_or_empty
from tidelog.llm.words import Words, grams, mask, portions, sliding_min

IS_WORD = mask([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Words of a window, of a hashed gram, and grams in a window.
WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
#: Largest benchmark, in bytes of text, that is broadcast; a larger one is joined by fingerprint.
BROADCAST_BYTES = 16 << 20


def fingerprints(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the winnowed grams, all grams, and which grams start a window of ten."""
    g = grams(words.hash, GRAM)
    whole = np.zeros(max(len(words.hash) - WINDOW + 1, 0), bool)
    if len(whole):
        whole = words.doc[: len(whole)] == words.doc[WINDOW - 1 :]
        least = sliding_min(g, SPAN)
        chosen = np.zeros(len(g), bool)
        for j in range(SPAN):
            chosen[j : j + len(whole)] |= whole & (g[j : j + len(whole)] == least)
        return np.flatnonzero(chosen), g, whole
    return np.zeros(0, np.int64), g, whole


class Index:
    """Fingerprints and windows of benchmark items."""

    def __init__(self, items: list[tuple[object, bytes | None]]):
        kept = sorted({(str(i), t) for i, t in items if i is not None and t})
        self.names = [i for i, _ in kept]
        w = Words([t for _, t in kept], IS_WORD)
        at, g, self.whole = fingerprints(w)
        order = np.argsort(g[at], kind="stable")
        self.prints, self.places = g[at][order], at[order]
        self.tens, self.item = grams(w.hash, WINDOW), w.doc
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in range(1, WINDOW):
            own = np.flatnonzero(w.per_doc == m)
            if len(own):
                h = grams(w.hash, m)[w.first[own]]
                order = np.argsort(h, kind="stable")
                self.short[m] = (h[order], own[order])


def _pairs(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with values[i] == table[j]; the table is sorted."""
    lo, hi = np.searchsorted(table, values, "left"), np.searchsorted(table, values, "right")
    n = hi - lo
    i = np.repeat(np.arange(len(values)), n)
    return i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[i]


def match(texts: list[bytes], index: Index) -> list[tuple[int, int, list[str]]]:
    """(n_words, n_hit, item names) of each text."""
    w = Words(texts, IS_WORD)
    n = len(w.hash)
    change = np.zeros(n + 1, np.int64)
    docs, items = [], []
    at, g, whole = fingerprints(w)
    i, j = _pairs(g[at], index.prints)
    pos, place = at[i], index.places[j]
    if len(pos):
        tens = grams(w.hash, WINDOW)
        for back in range(SPAN):  # every window that holds the shared gram
            a, b = pos - back, place - back
            ok = (a >= 0) & (b >= 0) & (a < len(whole)) & (b < len(index.whole))
            a, b = a[ok], b[ok]
            ok = whole[a] & index.whole[b] & (tens[a] == index.tens[b])
            a, b = a[ok], b[ok]
            one = np.unique(a)
            change[one] += 1
            change[one + WINDOW] -= 1
            docs.append(w.doc[a])
            items.append(index.item[b])
    for m, (hashes, own) in index.short.items():
        if n < m:
            continue
        i, j = _pairs(grams(w.hash, m), hashes)
        ok = w.doc[i] == w.doc[i + m - 1]
        a, b = i[ok], own[j[ok]]
        one = np.unique(a)
        change[one] += 1
        change[one + m] -= 1
        docs.append(w.doc[a])
        items.append(b)
    hit = np.cumsum(change[:-1]) > 0
    n_hit = np.bincount(w.doc[hit], minlength=len(texts)) if n else np.zeros(len(texts), int)
    found: list[set[str]] = [set() for _ in texts]
    if docs:
        both = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)]), axis=1)
        for d, k in both.T.tolist():
            found[d].add(index.names[k])
    return [(int(w.per_doc[d]), int(n_hit[d]), sorted(found[d])) for d in range(len(texts))]


FOUND = ["n_words", "n_hit", "items"]


def _rows(own: list[pa.Array], names: list[str], got: list[tuple[int, int, list[str]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*own, pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.list_(pa.string()))],
        names=[*names, *FOUND],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`docs` with n_words, n_hit (words inside any occurrence of a benchmark window) and
    items (ids, as strings, of items with an occurring window, sorted) added; columns of
    these names are replaced.

    Null or empty texts have no words; null item ids and texts match nothing; repeated
    items and documents count as themselves; an empty benchmark hits nothing.  A benchmark
    of at most `broadcast_bytes` is broadcast; a larger one is joined by fingerprint,
    and the windows of documents that share one are joined with the benchmark's.
    """
    spark = docs.sparkSession
    docs = docs.drop(*FOUND)
    names, text_at = docs.columns, docs.columns.index(text_col)
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_words long, n_hit long, items array<string>"])
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("item_text")).where("item is not null and item_text is not null")
    size = items.agg(F.sum(F.octet_length("item_text") + F.octet_length("item") + 16)).first()[0] or 0
    if size <= broadcast_bytes:
        sent = spark.sparkContext.broadcast([(r["item"], r["item_text"].encode()) for r in items.collect()])

        def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = None
            for b in slices(batches, 2000):
                if index is None:
                    claim("windows")
                    index = Index(sent.value)
                texts = text_or_empty(b.column(text_at))
                yield _rows(b.columns, names, [x for lo, hi in portions(texts) for x in match(texts[lo:hi], index)])

        return docs.mapInArrow(small, out)

    # A larger benchmark: fingerprints are joined, and only documents that share one are extended.
    spread = items.distinct()
    per_item = spread.mapInArrow(_word_counts, "words long")
    lengths = sorted(r["words"] for r in per_item.where(F.col("words").between(1, WINDOW - 1)).distinct().collect())  # at most nine numbers
    of_items = spread.mapInArrow(partial(_emit, lengths=lengths, whole=True, every=False), "key string, print long")
    windows = spread.mapInArrow(partial(_emit, lengths=lengths, whole=True, every=True), "key string, print long").withColumnsRenamed({"key": "item", "print": "window"})
    keyed = docs.select(F.concat_ws(":", F.col(id_col).cast("string"), F.sha2(F.coalesce(text_col, F.lit("")), 256)).alias("_key"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"))
    texts = keyed.select(F.col("_key").alias("key"), F.col("_row").getField(text_col).alias("text"))
    of_docs = texts.mapInArrow(partial(_emit, lengths=lengths, whole=False, every=False), "key string, print long")
    near = of_docs.join(of_items.select("print").distinct(), "print", "left_semi").select("key").distinct()
    of_near = texts.join(near, "key", "left_semi").mapInArrow(partial(_emit, lengths=lengths, whole=False, every=True), "key string, print long").withColumnRenamed("print", "window")
    shared = save(of_near.join(windows.select("window").distinct(), "window", "left_semi").distinct(), "windows").df
    # a document's lists are no longer than its words, and than the items that occur in it
    hit = shared.groupBy("key").agg(F.collect_list("window").alias("hit"))
    held = shared.join(windows.distinct(), "window").select("key", "item").distinct().groupBy("key").agg(F.collect_list("item").alias("held"))

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, got = b.column(0).flatten(), []
            for text, hashes, found in zip(text_or_empty(own[text_at]), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = Words([text], IS_WORD)
                change, known = np.zeros(len(w.hash) + 1, np.int64), np.array(hashes or [], np.int64).view(np.uint64)
                for m in [*lengths, WINDOW] if hashes else []:
                    at = np.flatnonzero(np.isin(_named(grams(w.hash, m), m), known))
                    change[at] += 1
                    change[at + m] -= 1
                got.append((len(w.hash), int((np.cumsum(change[:-1]) > 0).sum()), sorted(found or [])))
            yield _rows(own, names, got)

    whole = keyed.join(hit.withColumnRenamed("key", "_key"), "_key", "left").join(held.withColumnRenamed("key", "_key"), "_key", "left")
    return whole.select("_row", "hit", "held").mapInArrow(large, out)


def _named(h: np.ndarray, m: int) -> np.ndarray:
    """Hashes of windows of m words, apart from those of other lengths."""
    return h ^ np.uint64(m)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = text_or_empty(b.column(1))
        for lo, hi in portions(texts):
            yield pa.RecordBatch.from_arrays([pa.array(Words(texts[lo:hi], IS_WORD).per_doc.astype(np.int64))], names=["words"])


def _emit(batches: Iterator[pa.RecordBatch], lengths: list[int], whole: bool, every: bool) -> Iterator[pa.RecordBatch]:
    """(key, hash) of each text's winnowed fingerprints, or, with `every`, of its windows of ten
    words; and of its windows of each of `lengths`, with `whole` only those that are whole texts."""
    for b in batches:
        texts = text_or_empty(b.column(1))
        for lo, hi in portions(texts):
            w = Words(texts[lo:hi], IS_WORD)
            if every:
                h = grams(w.hash, WINDOW)
                at = np.flatnonzero(w.doc[: len(h)] == w.doc[WINDOW - 1 :]) if len(h) else np.zeros(0, np.int64)
                hashes, owners = [_named(h[at], WINDOW)], [w.doc[at]]
            else:
                at, g, _ = fingerprints(w)
                hashes, owners = [g[at]], [w.doc[at]]
            for m in lengths:  # a short item's window is its own fingerprint
                h = grams(w.hash, m)
                at = np.flatnonzero((w.doc[: len(h)] == w.doc[m - 1 :]) & ((w.per_doc[w.doc[: len(h)]] == m) | (not whole))) if len(h) else np.zeros(0, np.int64)
                hashes.append(_named(h[at], m))
                owners.append(w.doc[at])
            both = np.unique(np.stack([np.concatenate(owners).astype(np.uint64), np.concatenate(hashes)]), axis=1)
            for at in range(0, both.shape[1], 50_000):
                part = both[:, at : at + 50_000]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(part[0].astype(np.int64))), pa.array(part[1].view(np.int64))], names=["key", "print"])
