"""Token counts with a two-tier map-side lookup.

Tier one is a compact table of the lengths, in tokens, of frequent pieces of text (see
:mod:`tidelog.llm.bpe`), broadcast once; tier two is each worker's own bounded cache of
the pieces that it missed, encoded by the tokenizer.  No piece is ever shuffled: only the
frequency summaries that choose tier one move, one bounded row for each partition.  Which
pieces are in tier one changes the time taken and never the counts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import bpe
from tidelog.llm.common import slices, task_id

#: Fixed bounds of the frequency summaries: entries counted at once in a task, sent by a
#: task, and kept in the broadcast table; longest piece kept, in characters.
COUNTED, SENT, KEPT, LONGEST = 200_000, 4096, 16_384, 48
GROUPS = 16


def _heavy(counts: Counter, n: int) -> Counter:
    """The n heaviest, less the weight of the heaviest that is left out (Misra-Gries)."""
    if len(counts) <= n:
        return counts
    top = counts.most_common(n + 1)
    return Counter({k: v - top[n][1] for k, v in top[:n] if v > top[n][1]})


def _blob(counts: Counter) -> bytes:
    keys = list(counts)
    return zlib.compress("\x00".join(keys).encode()) + b"|" + np.array([counts[k] for k in keys], np.int64).tobytes() + np.array([len(keys)], np.int64).tobytes()


def _unblob(blob: bytes) -> Counter:
    n = int(np.frombuffer(blob[-8:], np.int64)[0])
    values = np.frombuffer(blob[len(blob) - 8 - 8 * n : len(blob) - 8], np.int64).tolist()
    keys = zlib.decompress(blob[: len(blob) - 9 - 8 * n]).decode().split("\x00") if n else []
    return Counter(dict(zip(keys, values, strict=True)))


def frequent_pieces(docs: DataFrame, text: str = "text") -> list[str]:
    """The heaviest pieces of all texts, at most KEPT of them, heaviest first.

    Each task keeps a bounded summary of its own texts; summaries meet in GROUPS tasks,
    and the driver gets GROUPS bounded rows at any size of the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                if t:
                    held.update(bpe.pieces(t))
                    if len(held) > COUNTED:
                        held = _heavy(held, COUNTED // 4)
        held = _heavy(Counter({k: v for k, v in held.items() if 0 < len(k) <= LONGEST and "\x00" not in k}), SENT)
        yield pa.RecordBatch.from_arrays([pa.array([task_id() % GROUPS], pa.int32()), pa.array([_blob(held)], pa.binary())], names=["g", "blob"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for blob in b.column(1).to_pylist():
                held.update(_unblob(blob))
                held = _heavy(held, 2 * KEPT) if len(held) > 8 * KEPT else held
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([_blob(_heavy(held, KEPT))], pa.binary())], names=["g", "blob"])

    sent = docs.select(F.col(text).alias("text")).mapInArrow(count, "g int, blob binary")
    total: Counter = Counter()
    for row in sent.repartition(GROUPS, "g").mapInArrow(meet, "g int, blob binary").collect():
        total.update(_unblob(bytes(row["blob"])))
    return [k for k, _ in total.most_common(KEPT)]


def length_table(path: str, keys: list[str]) -> bytes:
    """Tier one as bytes: the pieces, and one unsigned 16-bit length for each."""
    encoder = bpe.Bpe(path)
    keys = keys if encoder.cuts else []  # texts go whole to a tokenizer that pieces don't suit
    found = encoder.encode_pieces(keys)
    keys = [k for k in keys if found[k] is not bpe.BAD]
    lengths = np.array([len(found[k]) // 4 for k in keys], np.uint16)
    return zlib.compress(len(keys).to_bytes(4, "little") + lengths.tobytes() + "\x00".join(keys).encode())


def read_length_table(blob: bytes) -> dict[str, int]:
    raw = zlib.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    keys = raw[4 + 2 * n :].decode().split("\x00") if n else []
    return dict(zip(keys, np.frombuffer(raw, np.uint16, n, 4).tolist(), strict=True))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """One row for each document: its id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and ids each give a row;
    other columns of `docs` are ignored, whatever their names; an empty table gives none.
    """
    path = tokenizer or bpe.default_path()
    only = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tier = docs.sparkSession.sparkContext.broadcast(length_table(path, frequent_pieces(docs, text_col)))
    kind = only.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in slices(batches):
            if encoder is None:
                name = str(zlib.crc32(tier.value))
                encoder = bpe.loaded(path, name)
                if not encoder.base:
                    encoder.base = read_length_table(tier.value)
                    encoder.counts.update(encoder.base)
            texts = b.column(1)
            n = np.array(encoder.n_tokens([t or "" for t in texts.to_pylist()]), np.int64)
            size = np.array([0 if x is None else len(x) for x in texts.cast(pa.binary()).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return only.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
