"""Things that several operators share: tables, shared storage, prefix sums, blobs."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_LIBC = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is named, a local one, and only
    if the executors run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What has been written and not dropped yet.
OPEN: list[Saved] = []


class Saved:
    """A written intermediate table: lineage ends here, and lost executors reread it."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tidelog-{label}-{uuid.uuid4().hex}"
        self.schema = df.schema
        OPEN.append(self)
        df.write.option("compression", "zstd").parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        if self in OPEN:
            OPEN.remove(self)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Chunks(Saved):
    """A chunk store (see chunks): a table of the session's catalog, its files in the shared folder."""

    def __init__(self, made: DataFrame, label: str):
        self.spark = made.sparkSession
        self.name = f"tidelog_{label}_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        OPEN.append(self)
        n = shuffle_partitions(self.spark)
        # dealt first, so that a bucket is one file and not one for each task that has a chunk of it
        made.repartition(n, "chunk").write.bucketBy(n, "chunk").option("path", self.path).option("compression", "uncompressed").format("parquet").saveAsTable(self.name)

    @property
    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        super().drop()


def save(df: DataFrame, label: str) -> Saved:
    return Saved(df, label)


_CACHES: list[Callable[[], None]] = []
_CLAIMED: list[str] = []


def cache(clear: Callable[[], None]) -> None:
    """Registers how to free what a module keeps in a worker between tasks."""
    _CACHES.append(clear)


def claim(name: str) -> None:
    """At the head of a task or chunk: if the worker's last task was another operator's, what that one
    has kept is freed, so that workers of long sessions hold one operator's caches at a time.
    What the allocators hold without use goes back to the system."""
    if _CLAIMED and _CLAIMED[-1] != name:
        for clear in _CACHES:
            clear()
        gc.collect()
    _CLAIMED[:] = [name]
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # glibc's
        _LIBC.malloc_trim(0)


def task_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows: what Python makes of a text is many times the text."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def text_or_empty(array: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in array.cast(pa.binary()).to_pylist()]


def running(df: DataFrame, order: list[str], sums: list[str], label: str) -> DataFrame:
    """Adds `row_start` and, for each column of `sums`, `<column>_start`: the exclusive
    prefix count and sums in the order given, over the whole table.

    The table is range-partitioned, each partition adds up its own rows, and the
    partitions' totals (one row for each partition, so their number is the number of
    partitions and not that of rows) shift them.  `order` must be a total order up to
    rows that are alike.  `df` is read twice (range bounds are sampled), so it should be
    a scan or a saved table.
    """
    spark = df.sparkSession
    names = df.columns
    schema = T.StructType([*df.schema.fields, *(T.StructField(f"{c}_start", T.LongType()) for c in ["row", *sums]), T.StructField("_part", T.IntegerType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = dict.fromkeys(["row", *sums], 0)
        part = task_id()
        for b in batches:
            extra = []
            for c in ["row", *sums]:
                v = np.ones(b.num_rows, np.int64) if c == "row" else b.column(names.index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(v)
                extra.append(pa.array(ends - v + at[c]))
                at[c] += int(ends[-1]) if len(ends) else 0
            yield pa.RecordBatch.from_arrays([*b.columns, *extra, pa.array(np.full(b.num_rows, part, np.int32))], names=[f.name for f in schema])

    parts = shuffle_partitions(spark)
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    done = save(ranged.mapInArrow(local, schema), label).df
    ends = [F.max(F.col("row_start") + 1).alias("row"), *(F.max(F.col(f"{c}_start") + F.col(c)).alias(c) for c in sums)]
    totals = sorted((r.asDict() for r in done.groupBy("_part").agg(*ends).collect()), key=lambda r: r["_part"])
    at = dict.fromkeys(["row", *sums], 0)
    rows = []
    for r in totals:
        rows.append((r["_part"], *(at[c] for c in ["row", *sums])))
        for c in ["row", *sums]:
            at[c] += r[c]
    fields = [T.StructField("_part", T.IntegerType()), *(T.StructField(f"_{c}_base", T.LongType()) for c in ["row", *sums])]
    bases = spark.createDataFrame(rows, T.StructType(fields))
    out = done.join(F.broadcast(bases), "_part")
    return out.select(*names, *((F.col(f"{c}_start") + F.col(f"_{c}_base")).alias(f"{c}_start") for c in ["row", *sums]))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as a compressed blob; integers are cut to the bytes they need."""
    n = len(arrays[0])
    head, planes = [np.array([n, len(arrays)], np.int64).tobytes()], []
    for a in arrays:
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(n, a.dtype.itemsize) if n else np.zeros((0, a.dtype.itemsize), np.uint8)
        head.append(a.dtype.str.encode().ljust(8))
        planes.append(np.ascontiguousarray(raw.T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, k = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    kinds = [np.dtype(raw[16 + 8 * i : 24 + 8 * i].decode().strip()) for i in range(k)]
    at, out = 16 + 8 * k, []
    for kind in kinds:
        size = n * kind.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += size
    return out


def mix(a: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    a = a ^ (a >> np.uint64(31))
    a = a * np.uint64(0x9E3779B97F4A7C15)
    a = a ^ (a >> np.uint64(29))
    a = a * np.uint64(0xBF58476D1CE4E5B9)
    return a ^ (a >> np.uint64(32))


def by_group(names: list[str], key: str, work: Callable[[object, pa.Table], Iterator[pa.RecordBatch]]) -> Callable:
    """For mapInArrow over partitions that are sorted by `key`: `work` gets each key's rows
    as one table.  Callers bound what a key holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("groups")
        held: list[pa.RecordBatch] = []
        now: object = None
        k = names.index(key)
        for b in batches:
            col = b.column(k).to_numpy(zero_copy_only=False)
            if not len(col):
                continue
            cuts = [0, *(np.flatnonzero(col[1:] != col[:-1]) + 1), len(col)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and col[lo] != now:
                    yield from work(now, pa.Table.from_batches(held))
                    held = []
                now = col[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from work(now, pa.Table.from_batches(held))

    return run


#: Links, about, that one task takes at once.
LINKS = 1 << 20


def contract(links: DataFrame, tasks: int) -> DataFrame:
    """Links (u, v) as links to the least node of each component that a task sees, v < u; tasks
    take whole partitions and hold a forest, no more than a link for each of their nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("groups")
        held, n = [], 0
        for b in chain(batches, [None]):
            if b is not None:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
                n += b.num_rows
            if held and (b is None or n > 2 * LINKS):
                forest = local_forest(*(np.concatenate(z) for z in zip(*held, strict=True)))
                held, n = [forest], len(forest[0])
        for u, v in held:
            for lo in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[lo : lo + 100_000]), pa.array(v[lo : lo + 100_000])], names=["u", "v"])

    return links.coalesce(tasks).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, label: str) -> DataFrame:
    """(a, b) links to (node, component): the smallest node reachable, for every node of an edge.

    Rounds of contraction inside tasks, of about LINKS links each, and, while there are several
    tasks, of alternating large-star and small-star steps between them.  Such a step is a partial
    aggregation and a join, so a node of very many links is split by adaptive execution; each
    round's table is written, and the rounds grow with the logarithm of the path length.
    """
    now = save(edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v"), f"{label}-cc")
    while True:
        tasks = -(-now.df.count() // LINKS)
        forest = save(contract(now.df, max(tasks, 1)), f"{label}-cc")
        now.drop()
        now = forest
        if tasks <= 1:
            break
        both = now.df.union(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        step = save(large, f"{label}-cc")
        least = step.df.groupBy("u").agg(F.min("v").alias("m"))
        moved = step.df.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = save(moved.where("u <> v").distinct(), f"{label}-cc")
        step.drop()
        now.drop()
        now = after
        heads = after.df.select(F.col("v").alias("u"), F.lit(0).alias("n")).distinct()  # a head is no one's member, a member has one head
        if not heads.union(after.df.select("u", F.lit(1).alias("n"))).groupBy("u").agg(F.count("*").alias("n")).where("n > 1").take(1):
            break
    pairs = now.df
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) of one task as links to each component's smallest node."""
    if not len(a):
        return a, b
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            break
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def chunks(df: DataFrame, size: int, text: str, label: str) -> Chunks:
    """Rows in chunks of about `size` bytes of text, as a table bucketed by chunk in the
    shared folder: chunk, n_rows, n_bytes, blob (an Arrow stream of the rows, compressed).

    A written chunk never changes, so later passes may refer to its rows by place; joins
    by chunk leave the table where it is and move only the other side.
    """
    at = df.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("groups")
        held: list[pa.RecordBatch] = []
        n = seq = 0

        def row() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(whole)
            return pa.RecordBatch.from_arrays([pa.array([task_id() << 32 | seq]), pa.array([whole.num_rows]), pa.array([n]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "n_rows", "n_bytes", "blob"])

        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(at).cast(pa.binary())), 0).to_numpy().astype(np.int64)
            lo = 0
            for i, s in enumerate(sizes.tolist()):
                n += s
                if n >= size:
                    held.append(b.slice(lo, i + 1 - lo))
                    yield row()
                    lo, held, n, seq = i + 1, [], 0, seq + 1
            if lo < b.num_rows:
                held.append(b.slice(lo))
        if held:
            yield row()

    return Chunks(df.mapInArrow(cut, "chunk long, n_rows long, n_bytes long, blob binary"), label)


def read_chunk(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks()


def power_of_two(x: float, least: int, most: int) -> int:
    n = least
    while n < x and n < most:
        n *= 2
    return n
