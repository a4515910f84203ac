"""Packing of documents into training sequences along a space-filling curve.

A document's token ids are counted in hashed slots; the normalised counts are projected
to a few dimensions; their place on a Hilbert curve is the document's key.  Documents are
range-sorted by key, a global prefix sum of their lengths gives each its place on one
long tape, and the tape is cut every `capacity` ids.  Only the last sequence may be short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import bpe
from tidelog.llm.common import running, save, task_id

#: Hashed slots of a document vector, dimensions of the projection, bits of each.
SLOTS, DIMS, BITS = 256, 3, 20


def projection() -> np.ndarray:
    """A fixed random matrix of signs, SLOTS by DIMS."""
    return np.random.default_rng(1024).choice([-1.0, 1.0], (SLOTS, DIMS))


def vectors(documents: list[np.ndarray]) -> np.ndarray:
    """The hashed count vector of each document's ids, of length 1; each has an id at least."""
    ids = np.concatenate(documents)
    slot = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)
    owner = np.repeat(np.arange(len(documents)) * SLOTS, [len(d) for d in documents])
    v = np.sqrt(np.bincount(owner + slot, minlength=len(documents) * SLOTS)).reshape(-1, SLOTS)
    return v / np.maximum(np.sqrt((v * v).sum(1)), 1e-12)[:, None]


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (a row each, of `bits` bits a dimension)."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):  # undo the turns of each level
        low = (1 << b) - 1
        for i in range(n):
            set_ = (x[i] >> b & 1).astype(bool)
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn = np.where(x[n - 1] >> b & 1, turn ^ ((1 << b) - 1), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(documents: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    if not documents:
        return np.zeros(0, np.int64)
    y = vectors(documents) @ matrix / np.sqrt(SLOTS)
    return hilbert(np.clip((y + 1) / 2, 0, 1 - 2.0**-BITS) * (1 << BITS), BITS)


def pack_sequences(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cached: int = bpe.KEPT) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and with `with_ids` the piece's ids (array<long>).

    A document is the ids of its text (null: empty) and `end_id`.  Each id lies in one
    piece; sequences are full but for the last one.  Repeated rows are documents of
    their own, other columns are ignored, and an empty table gives no pieces.  `cached`: pieces
    of text whose ids a worker keeps.
    """
    vocabulary = tokenizer or bpe.default_path()
    kind = docs.schema[id_col].dataType.simpleString()
    only = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    width = "<u2" if max(bpe.loaded(vocabulary).tok.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, matrix, n = bpe.loaded(vocabulary, limit=cached), projection(), 0
        end = np.array([end_id], "<u4").tobytes()
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                raw = [x + end for x in encoder.id_bytes([t or "" for t in some.column(1).to_pylist()])]
                ids = [np.frombuffer(x, "<u4") for x in raw]
                blobs = [press.compress(x.astype(width)) for x in ids]
                uid = (task_id() << 40) + n + np.arange(len(ids))
                n += len(ids)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(uid), pa.array(curve_keys(ids, matrix)), pa.array([len(x) for x in ids], pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "uid", "curve", "n", "blob"])

    tokens = save(only.mapInArrow(encode, f"doc_id {kind}, uid long, curve long, n long, blob binary"), "tokens").df
    places = running(tokens.select("uid", "curve", "n"), ["curve", "uid"], ["n"], "curve")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                some = b.slice(lo, 1000)
                owner, start, length, crc, ids = [], [], [], [], []
                tape = some.column(3).to_pylist()
                for i, (n, blob, at) in enumerate(zip(some.column(1).to_pylist(), some.column(2).to_pylist(), tape, strict=True)):
                    raw = np.frombuffer(press.decompress(blob), width).astype("<u4").tobytes()
                    s = 0
                    while s < n:
                        e = min(n, s + capacity - (at + s) % capacity)
                        owner.append(i)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(raw[4 * s : 4 * e]))
                        if with_ids:
                            ids.append(np.frombuffer(raw[4 * s : 4 * e], "<u4").astype(np.int64))
                        s = e
                own = pa.array(owner, pa.int64())
                at = np.array(tape, np.int64)[np.array(owner, np.int64)] + np.array(start, np.int64)
                columns = [some.column(0).take(own), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), some.column(1).take(own), pa.array(at // capacity), pa.array(at % capacity)]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(columns)])

    placed = tokens.join(places.select("uid", "n_start"), "uid").select("doc_id", "n", "blob", "n_start")
    return placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids)
