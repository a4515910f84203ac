"""Token ids in binary files of shuffled planes.

A file holds whole documents.  Its ids are cut into blocks of a fixed number of ids; a
block is transposed into byte planes (or bit planes), each plane is compressed with
zstandard, and a chunk index tells where each block's planes lie.  Files are the rows of
a table, so Spark's own writers commit them, on any store, and a lost executor's files
are written again.

File layout, little-endian: magic b"TLBP", version u8, planes u8 (4: bytes, 32: bits), block
u32; the planes; then the chunk index (for each block: offset u64, ids u32, and the
length u32 of each plane, 0 for a plane of zeros); the document index, compressed (ids
i64, their validity u8, lengths i64); and a tail: chunk index offset u64, blocks u32, document
index length u64, documents u64, ids u64, magic.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe
from tidelog.llm.common import shuffle_partitions, slices, task_id

MAGIC = b"TLBP"
#: Ids in a block, and in a file (a longer document has a file of its own).
BLOCK, FILE_IDS = 1 << 16, 1 << 20
TAIL = struct.Struct("<QIQQQ4s")


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes | None], n: int) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if len(planes) == 4:
        for i, p in enumerate(planes):
            if p is not None:
                raw[:, i] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for i, p in enumerate(planes):
            if p is not None:
                bits[:, i] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def encode_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, planes: int = 4, block: int = BLOCK, level: int = 1) -> bytes:
    press = zstandard.ZstdCompressor(level=level)
    out, index, at = [MAGIC + struct.pack("<BBI", 1, planes, block)], [], 10
    for lo in range(0, len(ids), block):
        some = ids[lo : lo + block]
        packed = [press.compress(p) if any(p) else b"" for p in to_planes(some, planes)]
        index.append(struct.pack(f"<QI{planes}I", at, len(some), *map(len, packed)))
        out += packed
        at += sum(map(len, packed))
    known = np.array([x is not None for x in doc_ids], np.uint8)
    table = press.compress(np.array([x or 0 for x in doc_ids], "<i8").tobytes() + known.tobytes() + np.array(lengths, "<i8").tobytes())
    return b"".join([*out, *index, table, TAIL.pack(at, len(index), len(table), len(doc_ids), len(ids), MAGIC)])


class TokenFile:
    """A file's bytes, opened: documents by the index, ids of any range by the chunk index."""

    def __init__(self, content: bytes):
        self.content = content
        self.index_at, self.blocks, size, self.n_docs, self.n_ids, magic = TAIL.unpack_from(content, len(content) - TAIL.size)
        if magic != MAGIC or content[:4] != MAGIC:
            raise ValueError("not a token file")
        _, self.planes, self.block = struct.unpack_from("<BBI", content, 4)
        end = len(content) - TAIL.size
        raw = zstandard.decompress(content[end - size : end])
        n = self.n_docs
        known = np.frombuffer(raw, np.uint8, n, 8 * n)
        self.doc_ids = [int(x) if k else None for x, k in zip(np.frombuffer(raw, "<i8", n), known, strict=True)]
        self.lengths = np.frombuffer(raw, "<i8", n, 9 * n)

    def read_block(self, i: int) -> np.ndarray:
        form = struct.Struct(f"<QI{self.planes}I")
        at, n, *sizes = form.unpack_from(self.content, self.index_at + i * form.size)
        planes: list[bytes | None] = []
        for s in sizes:
            planes.append(zstandard.decompress(self.content[at : at + s]) if s else None)
            at += s
        return from_planes(planes, n)

    def read(self, lo: int, hi: int) -> np.ndarray:
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first = lo // self.block
        got = np.concatenate([self.read_block(i) for i in range(first, -(-hi // self.block))])
        return got[lo - first * self.block : hi - first * self.block]


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", planes: int = 4, file_ids: int = FILE_IDS) -> None:
    """Encodes texts (null: empty), appends `end_id` and writes files in ascending id order.

    Rows of `path`: shard (range of ids), file (number in the shard), first_id (ids before
    it in the shard), n_docs, n_ids, content.  Null document ids come first; rows
    of one id lie side by side; other columns are ignored; an empty table makes no file.
    """
    vocabulary = tokenizer or bpe.default_path()
    spark = docs.sparkSession
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = only.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.loaded(vocabulary)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        shard, number, before = task_id(), 0, 0
        names: list[int | None] = []
        raws: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(raws), "<u4")
            content = encode_file(names, [len(r) // 4 for r in raws], ids, planes)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([before], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([content], pa.binary())], names=["shard", "file", "first_id", "n_docs", "n_ids", "content"])

        for b in slices(batches):
            doc_ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for lo in range(0, len(texts), 256):
                for name, raw in zip(doc_ids[lo : lo + 256], encoder.id_bytes(texts[lo : lo + 256]), strict=True):
                    raw += end
                    if names and held + len(raw) // 4 > file_ids:
                        yield flush()
                        number, before, names, raws, held = number + 1, before + held, [], [], 0
                    names.append(name)
                    raws.append(raw)
                    held += len(raw) // 4
        if names:
            yield flush()

    ordered.mapInArrow(encode, "shard int, file long, first_id long, n_docs long, n_ids long, content binary").write.option("compression", "uncompressed").parquet(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of the files under `path`: doc_id, start (ids of all documents before it,
    over all files), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers)
    and, if asked, ids (array<long>).  Each file is decoded alone."""
    files = spark.read.parquet(path)
    at, bases = 0, []
    for r in sorted(files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r["shard"]):  # one row for each range
        bases.append((r["shard"], at))
        at += r["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, first, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                f = TokenFile(content)
                ids = f.read(0, f.n_ids)
                raw = memoryview(ids.tobytes())
                ends = np.cumsum(f.lengths)
                spans = list(zip((ends - f.lengths).tolist(), ends.tolist(), strict=True))
                columns = [
                    pa.array([shard] * f.n_docs, pa.int32()), pa.array(f.doc_ids, pa.int64()), pa.array([first + lo for lo, _ in spans], pa.int64()),
                    pa.array(f.lengths.astype(np.int64)), pa.array([zlib.crc32(raw[4 * lo : 4 * hi]) for lo, hi in spans], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "local", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    found = files.select("shard", "first_id", "content").mapInArrow(decode, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    shift = spark.createDataFrame(bases, "shard int, _base long")
    out = found.join(F.broadcast(shift), "shard")
    return out.select("doc_id", (F.col("local") + F.col("_base")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
