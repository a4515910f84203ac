"""Removal of repeated byte strings by longest-previous-factor arrays over sparse suffixes.

A byte goes if a string of T bytes that covers it also starts in a document of smaller id.
Suffixes of all positions would be many times the corpus, so it is cut down first, exactly:

1. Of every T bytes in a row, the least hash of its K-byte grams is an anchor; equal
   strings have equal anchors at equal places.  An anchor's context is all bytes that a
   string of T around it can reach.  Each chunk of documents sends its distinct
   contexts as (gram hash, context hash, smallest document) to buckets by gram hash.
   A context that also lies in a document of smaller id is removed whole; a gram that
   has several contexts needs its strings compared.
2. Only for those, the smallest document of each context sends the context's bytes.  Each bucket
   sorts the suffixes that start a string of T bytes (suffix order, ties by document),
   takes longest common prefixes of neighbours, and finds for each suffix the previous
   and next one of a smaller document: its longest previous factor.  Where that
   reaches T bytes the string is an earlier one's copy.
3. Each chunk joins what it has learnt to its texts.

Chunks send a context once however many of their documents hold it, and hear one answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import by_group, chunks, claim, mix, pack, power_of_two, read_chunk, save, unpack
from tidelog.llm.words import BASE, BYTES, INVERSE, portions, powers, sliding_min

#: Bytes of a string, of a gram; bytes of text in a chunk and, about, for each bucket.
T, K = 50, 20
W = T - K + 1
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 2 << 20
LAST = np.uint64(2**64 - 1)
#: Contexts, about, whose strings are sorted together.
PORTION = 4096
#: A group of one gram that is asked for more contexts than this is compared by hashed strings, spread out.
WIDE = 20_000
SAME, ASK, SPREAD = 1, 2, 3


def _anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(place, first and last place of the context, text, gram hash, context hash) of each anchor
    of a portion of texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, sizes = len(data), np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    none = np.zeros(0, np.int64)
    if n < T:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[data] * powers(BASE, n + 1)[:n], out=sums[1:])
    inv = powers(INVERSE, n + 1)
    h = mix((sums[K:] - sums[:-K]) * inv[: n - K + 1])
    h[h == LAST] -= np.uint64(1)
    h[doc[: n - K + 1] != doc[K - 1 :]] = LAST
    whole = doc[: n - T + 1] == doc[T - 1 :]
    edge = np.zeros(W - 1, np.uint64)
    least = np.concatenate([edge, np.where(whole, sliding_min(h, W), np.uint64(0)), edge])
    at = np.flatnonzero((~sliding_min(~least, W) == h) & (h != LAST))
    doc = doc[at]
    lo, hi = np.maximum(at - (W - 1), (ends - sizes)[doc]), np.minimum(at + T, ends[doc])
    shape = (at - lo).astype(np.uint64) * np.uint64(256) + (hi - at).astype(np.uint64)
    # hashes that were least are small: mixed again, they spread evenly over buckets
    return at, lo, hi, doc, mix(h[at]), mix((sums[hi] - sums[lo]) * inv[lo] + mix(shape + np.uint64(1)))


class Anchors:
    """Anchors of a chunk's documents and its distinct contexts (entries, sorted)."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        """`ids`: document ids; texts of documents without an id must be empty."""
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        parts = []
        for first, last in portions(texts):  # one after the other, in little memory
            at, lo, hi, doc, h, context = _anchors(texts[first:last])
            base = starts[first]
            parts.append((at + base, lo + base, hi + base, doc + first, h, context))
        none = np.zeros(0, np.int64)
        at, lo, hi, doc, h, context = (np.concatenate(z) for z in zip((*[none] * 4, *[none.view(np.uint64)] * 2), *parts, strict=True))
        order = np.lexsort((ids[doc], context, h))
        self.at, self.lo, self.hi, self.doc, h, context = (z[order] for z in (at, lo, hi, doc, h, context))
        new = np.concatenate([np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (context[1:] != context[:-1])])
        self.entry = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.h, self.context, self.least = h[new], context[new], ids[self.doc[new]]


def _load(blob: bytes, id_col: str, text_col: str) -> tuple[pa.Table, np.ndarray, list[bytes], Anchors]:
    claim("groups")
    t = read_chunk(blob)
    ids = t.column(id_col)
    known = ids.is_valid().to_numpy()
    numbers = np.array([0 if x is None else x for x in ids.to_pylist()], np.int64)
    texts = [b"" if x is None else x for x in t.column(text_col).cast(pa.binary()).to_pylist()]
    return t, numbers, texts, Anchors(numbers, [x if k else b"" for x, k in zip(texts, known, strict=True)])


def _cut(h: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, lo, hi) of sorted hashes by their first bits."""
    b = (h >> np.uint64(64 - bits)).astype(np.int64)
    edges = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)] if len(b) else [0]
    return [(int(b[lo]), lo, hi) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


def _batch(chunk: list, bucket: list, blob: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())], names=["chunk", "bucket", "blob"])


def answer_entries(h: np.ndarray, context: np.ndarray, doc: np.ndarray, wide: int = WIDE) -> np.ndarray:
    """SAME for an entry whose context lies in a smaller document; ASK (or SPREAD, in a wide
    group) for each entry of the context's smallest document (rows of one id may lie in several
    chunks) if its gram has other contexts in other documents; else 0."""
    order = np.lexsort((doc, context, h))
    h, context, doc = h[order], context[order], doc[order]
    out = np.zeros(len(h), np.uint8)
    if not len(h):
        return out
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (context[1:] != context[:-1])])
    firsts = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    same = doc > doc[firsts][which]
    groups = np.flatnonzero(np.concatenate([[True], h[firsts][1:] != h[firsts][:-1]]))
    several = np.minimum.reduceat(doc[firsts], groups) < np.maximum.reduceat(doc[firsts], groups)
    asked = np.add.reduceat(~same, firsts[groups], dtype=np.int64)
    kind = np.repeat(np.where(several, np.where(asked > wide, SPREAD, ASK), 0), np.diff(np.append(groups, len(firsts))))
    code = np.where(same, SAME, kind[which]).astype(np.uint8)
    out[order] = code
    return out


def neighbours_lcp(rows: np.ndarray) -> np.ndarray:
    """Longest common prefix of each row of bytes with the one before it; the first's is 0."""
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.concatenate([[0], first])


def factors(value: np.ndarray, lcp: np.ndarray, least: int = 1) -> np.ndarray:
    """For each place of a suffix order (lcp[i]: of places i - 1 and i) the longest match with
    a suffix of smaller value, from the previous and the next place of a smaller value.
    Matches shorter than `least` may be given as 0.

    A smaller value is looked for by halving steps over minima of windows, no further than the
    longest run of prefixes of `least` or more."""
    n = len(value)
    best = np.zeros(n, np.int64)
    if not n:
        return best
    heads = np.flatnonzero(np.concatenate([[True], lcp[1:] < least, [True]]))
    levels = int(np.diff(heads).max()).bit_length()
    for v, m in ((value, lcp[1:]), (value[::-1], lcp[:0:-1])):
        lows, mins = [v], [np.concatenate([[0], m])]
        for k in range(levels - 1):
            lows.append(np.concatenate([lows[k][: 1 << k], np.minimum(lows[k][1 << k :], lows[k][: -(1 << k)])]))
            mins.append(np.concatenate([mins[k][: 1 << k], np.minimum(mins[k][1 << k :], mins[k][: -(1 << k)])]))
        at, reach = np.arange(n) - 1, mins[0]
        for k in range(levels - 1, -1, -1):
            place = np.maximum(at, 0)
            skip = (at >= 0) & (lows[k][place] >= v)
            reach = np.where(skip, np.minimum(reach, mins[k][place]), reach)
            at = np.where(skip, at - (1 << k), at)
        reach = np.where((at >= 0) & (v[np.maximum(at, 0)] < v), reach, 0)
        best = np.maximum(best, reach if v is value else reach[::-1])
    return best


def copies(rows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each suffix (a row, filled up with zeros, of T bytes at least) has a longest
    previous factor of T bytes or more, among the suffixes of documents of smaller id.

    Suffixes that share less than T bytes with both neighbours can't and are left out."""
    keys = np.concatenate([rows, np.ones((len(rows), 1), np.uint8)], 1)
    text = np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").reshape(-1)
    order = np.lexsort((doc, text))
    lcp = neighbours_lcp(rows[order])
    near = lcp >= T
    at = np.flatnonzero(near | np.append(near[1:], False))
    out = np.zeros(len(rows), bool)
    out[order[at]] = factors(doc[order[at]], lcp[at], T) >= T
    return out


def longest_previous(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest-previous-factor array: for each position of `order` (a suffix order of the
    positions 0 to n-1, lcp[i] that of order[i-1] and order[i]) the longest match with a
    suffix that starts earlier."""
    best = np.zeros(len(order), np.int64)
    best[order] = factors(order, lcp)
    return best


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, chunk_bytes: int = CHUNK_BYTES, wide: int = WIDE, portion: int = PORTION) -> DataFrame:
    """`docs` with n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with
    `keep_text`, kept (the bytes left) and kept_text (these as text, less the rests of
    characters that were cut) added; columns of these names are replaced.

    Ids are integers; rows of one id are no copies of each other, and rows without an id
    keep their text and are no one's source.  Null texts are empty.  Repeated rows each
    give a row, and an empty table gives none.  A gram asked for more than `wide` contexts is
    compared spread out; others are sorted about `portion` contexts at a time.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text")
    store = chunks(docs, chunk_bytes, text_col, "texts")
    total = store.df.agg(F.sum("n_bytes")).first()[0] or 0
    bits = power_of_two(total / BUCKET_BYTES, 128, 1 << 20).bit_length() - 1
    part = "chunk long, bucket int, blob binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = _load(blob, id_col, text_col)[3]
                low = (a.h << np.uint64(bits)) >> np.uint64(24)
                cut = _cut(a.h, bits)
                blobs = [pack(np.diff(low[lo:hi], prepend=np.uint64(0)), a.context[lo:hi] >> np.uint64(16), a.least[lo:hi]) for _, lo, hi in cut]
                yield _batch([chunk] * len(cut), [c[0] for c in cut], blobs)

    def answer(bucket: object, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        got = [unpack(x) for x in rows.column("blob").to_pylist()]
        sizes = [len(x[0]) for x in got]
        code = answer_entries(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in got]), np.concatenate([x[1] for x in got]), np.concatenate([x[2] for x in got]), wide)
        ends = np.cumsum(sizes)
        yield _batch(rows.column("chunk").to_pylist(), [bucket] * len(got), [zstandard.compress(code[e - s : e].tobytes(), 3) for e, s in zip(ends, sizes, strict=True)])

    def by_bucket(df: DataFrame, work) -> DataFrame:
        return df.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(by_group(["chunk", "bucket", "blob"], "bucket", work), part)

    def with_answers(answers: DataFrame) -> DataFrame:
        lists = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "blob")).alias("answers"))
        return store.df.select("chunk", "blob").join(lists, "chunk", "left")

    answers = by_bucket(store.df.select("chunk", "blob").mapInArrow(send, part), answer)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bucket -1: what the chunk removes whole, and where its asked contexts stand.
        Other buckets: the asked contexts.  From -2 down: strings of wide groups."""
        for b in batches:
            for chunk, blob, said in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                _, ids, _, a = _load(blob, id_col, text_col)
                raw = b"".join(zstandard.decompress(x["blob"]) for x in sorted(said or [], key=lambda x: x["bucket"]))
                code = np.frombuffer(raw, np.uint8)
                mine = ids[a.doc] if len(a.doc) else np.zeros(0, np.int64)
                gone = (code[a.entry] == SAME) | (mine > a.least[a.entry]) if len(a.at) else np.zeros(0, bool)
                change = np.zeros(len(a.data) + 1, np.int32)
                np.add.at(change, a.lo[gone], 1)
                np.add.at(change, a.hi[gone], -1)
                cover = np.concatenate([[False], np.cumsum(change[:-1], dtype=np.int32) > 0, [False]])
                flips = np.flatnonzero(cover[1:] != cover[:-1])
                asked = np.flatnonzero(code >= ASK)
                place = np.full(len(code) + 1, -1)
                place[asked] = np.arange(len(asked))
                here = (place[a.entry] >= 0) & (mine == a.least[a.entry]) if len(a.at) else np.zeros(0, bool)
                note = [pack(flips[::2], flips[1::2]), pack(a.at[here], place[a.entry[here]])]
                head = len(note[0]).to_bytes(8, "little")
                out = ([chunk], [-1], [head + note[0] + note[1]])
                first = a.first[asked] if len(asked) else np.zeros(0, np.int64)
                left, right = a.at[first] - a.lo[first], a.hi[first] - a.at[first]
                cols = np.arange(-(W - 1), T)
                where = a.at[first][:, None] + cols[None, :]
                inside = (where >= a.lo[first][:, None]) & (where < a.hi[first][:, None])
                rows = np.where(inside, a.data[np.clip(where, 0, max(len(a.data) - 1, 0))], 0).astype(np.uint8) if len(first) else np.zeros((0, W - 1 + T), np.uint8)
                for bucket, lo, hi in _cut(a.h[asked], bits):
                    spread = code[asked[lo:hi]] == SPREAD
                    for wide in (False, True):
                        at = lo + np.flatnonzero(spread == wide)
                        if len(at):
                            out[0].append(chunk)
                            out[1].append(-2 - bucket if wide else bucket)
                            body = pack(at, a.least[asked[at]], left[at].astype(np.uint8), right[at].astype(np.uint8))
                            out[2].append(len(body).to_bytes(8, "little") + body + zstandard.compress(rows[at].tobytes(), 3))
                yield _batch(*out)

    learnt = save(with_answers(answers).select("chunk", "blob", "answers").mapInArrow(learn, part), "learnt").df

    def opened(blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
        n = int.from_bytes(blob[:8], "little")
        return unpack(blob[8 : 8 + n]), np.frombuffer(zstandard.decompress(blob[8 + n :]), np.uint8).reshape(-1, W - 1 + T)

    def strings(doc: np.ndarray, left: np.ndarray, right: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, distance of the anchor from the start, bytes) of all suffixes that start a
        string of T, cut or filled up to `width` bytes."""
        entry, back, body = [], [], []
        for o in range(W):
            ok = np.flatnonzero((o <= left) & (T - o <= right))
            entry.append(ok)
            back.append(np.full(len(ok), o))
            part = rows[ok, W - 1 - o : W - 1 - o + width]
            body.append(np.pad(part, ((0, 0), (0, width - part.shape[1]))))
        return np.concatenate(entry), np.concatenate(back), np.concatenate(body)

    def compare(bucket: object, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        got = [opened(x) for x in rows.column("blob").to_pylist()]
        at, doc, left, right = (np.concatenate([x[0][i] for x in got]) for i in range(4))
        rows_of = np.concatenate([x[1] for x in got])
        gram = (BYTES[rows_of[:, W - 1 : W - 1 + K]] * powers(BASE, K)[:K]).sum(1)
        order = np.argsort(gram, kind="stable")
        masks = np.zeros(len(at), np.uint32)
        # equal strings have equal anchors, so grams are sorted apart, a portion of them at a time
        firsts = np.flatnonzero(np.concatenate([[True], gram[order][1:] != gram[order][:-1]]))
        cuts = np.append(firsts[np.unique(np.searchsorted(firsts, np.arange(0, len(order), portion)).clip(max=len(firsts) - 1))], len(order))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = order[lo:hi]
            entry, back, body = strings(doc[own], left[own].astype(np.int64), right[own].astype(np.int64), rows_of[own], W - 1 + T)
            copy = copies(body, doc[own][entry])
            np.bitwise_or.at(masks, own[entry[copy]], np.uint32(1) << back[copy].astype(np.uint32))
        ends = np.cumsum([len(x[0][0]) for x in got])
        yield _batch(rows.column("chunk").to_pylist(), [bucket] * len(got), [pack(at[e - len(x[0][0]) : e], masks[e - len(x[0][0]) : e]) for e, x in zip(ends, got, strict=True)])

    narrow = by_bucket(learnt.where("bucket >= 0"), compare)

    # strings of wide groups: a row each, least document by (two hashes of the string)
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                (at, doc, left, right), rows = opened(blob)
                entry, back, body = strings(doc, left.astype(np.int64), right.astype(np.int64), rows, T)
                digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in body]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(at[entry]), pa.int64()), pa.array(at[entry]), pa.array(back.astype(np.int32)), pa.array(doc[entry]), pa.array(digest, pa.binary())], names=["chunk", "at", "back", "doc", "digest"])

    spread = learnt.where("bucket < -1").mapInArrow(explode, "chunk long, at long, back int, doc long, digest binary")
    least = spread.groupBy("digest").agg(F.min("doc").alias("least"))
    found = spread.join(least, "digest").where("doc > least").groupBy("chunk", "at").agg(F.sum(F.expr("shiftleft(1L, back)")).alias("mask"))

    def wide_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunk, at, mask = (b.column(i).to_numpy() for i in range(3))
            yield _batch(chunk.tolist(), [-2] * len(chunk), [pack(at[i : i + 1], mask[i : i + 1].astype(np.uint32)) for i in range(len(chunk))])

    facts = learnt.where("bucket = -1").union(narrow).union(found.mapInArrow(wide_rows, part))
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "kept_text"] if keep_text else [])]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, said in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                t = read_chunk(blob)
                known = t.column(id_col).is_valid().to_pylist()
                texts = [b"" if x is None else x for x in t.column(text_col).cast(pa.binary()).to_pylist()]
                sizes = [len(x) if k else 0 for x, k in zip(texts, known, strict=True)]
                change = np.zeros(sum(sizes) + 1, np.int32)
                own = next(x["blob"] for x in said if x["bucket"] == -1)
                n = int.from_bytes(own[:8], "little")
                lo, hi = unpack(own[8 : 8 + n])
                change[lo] += 1
                change[hi] -= 1
                at, place = unpack(own[8 + n :])
                masks = np.zeros(int(place.max()) + 1 if len(place) else 0, np.uint32)
                for x in said:
                    if x["bucket"] != -1:
                        i, m = unpack(x["blob"])
                        masks[i] |= m
                mine = masks[place] if len(place) else np.zeros(0, np.uint32)
                for o in range(W):
                    ok = at[(mine >> np.uint32(o)) & np.uint32(1) == 1] - o
                    np.add.at(change, ok, 1)
                    np.add.at(change, ok + T, -1)
                gone = np.cumsum(change[:-1], dtype=np.int32) > 0
                end, made = 0, {c: [] for c in names}
                for x, k, size in zip(texts, known, sizes, strict=True):
                    cut = gone[end : end + size]
                    end += size
                    out = cut.any()
                    kept = np.frombuffer(x, np.uint8)[~cut].tobytes() if out else x
                    made["n_bytes"].append(len(x))
                    made["n_removed"].append(len(x) - len(kept))
                    made["n_spans"].append(int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()) if out else 0)
                    made["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    if keep_text:
                        made["kept"].append(kept)
                        made["kept_text"].append(kept.decode("utf-8", "ignore"))
                kinds = {"kept_sha256": pa.string(), "kept": pa.binary(), "kept_text": pa.string()}
                whole = pa.RecordBatch.from_arrays([*(t.column(c).chunk(0) if t.num_rows else pa.array([], t.schema.field(c).type) for c in t.schema.names), *(pa.array(made[c], kinds.get(c, pa.int64())) for c in names)], names=[*t.schema.names, *names])
                for i in range(0, whole.num_rows, 2000):
                    yield whole.slice(i, 2000)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *(["kept binary, kept_text string"] if keep_text else [])])
    return with_answers(facts).select("chunk", "blob", "answers").mapInArrow(apply, schema)
