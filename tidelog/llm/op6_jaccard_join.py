"""Exact Jaccard join of shingle sets as a metric-space join, and its components.

Metrics.  Jaccard distance, and below it the symmetric difference of sets, plain or with
weights.  Equal sets are one node throughout.

Level one.  The pivots are single shingles, weighted by rarity.  A chunk of documents sends its
distinct shingles to buckets by hash and hears how many sets hold each.  In the symmetric
difference weighted so, the nearest pivot of a set is its rarest shingle: that is its
Voronoi cell.  A partner within the distance may lack the rarest shingles, but by the triangle
inequality no more of them than the distance allows, so a set is replicated to the cells of
its n - ceil(t n) + 1 rarest shingles, and every pair within the distance meets in a
cell.  A cell of one set is empty space: shingles that no other set holds are not even
sent, and a set with more of them than the window has cells can link with nothing.

Below.  A cell of more than LEAF sets is joined recursively: PIVOTS of its documents are its
pivots, every set's exact Jaccard distance to them is taken, and a set goes to the region
of its nearest pivot and to every region that is further by no more than twice the allowed
distance.  What the pivots link is one component at once, and regions of one component are
done.  A region that its pivots can't split is cut by size, and its largest component
against the others.  Cells of at most LEAF sets are compared whole, by a distance of
count vectors that never exceeds the symmetric difference; survivors are verified on the
whole sets.  A leaf first sends a spanning forest of its survivors, nearest first, and then
only pairs between components that were not tested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Saved, by_group, chunks, claim, components, pack, power_of_two, read_chunk, save, shuffle_partitions, unpack
from tidelog.llm.words import Words, grams, mask, portions

IS_WORD = mask([(0x20, 0x20), (0x09, 0x0D)])
SHINGLE, CLASSES = 5, 64
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 2 << 20
#: Most sets of a region that is compared whole; pivots of a larger one; levels of pivots before it is cut by size.
LEAF, PIVOTS, DEPTH = 256, 8, 6
#: Regions of up to so many are compared together.
SMALL = 8


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The set of each text as sorted 64-bit hashes."""
    out: list[np.ndarray] = []
    for lo, hi in portions(texts):
        w = Words(texts[lo:hi], IS_WORD)
        n = len(w.hash) - shingle + 1
        at = np.flatnonzero(w.doc[:n] == w.doc[shingle - 1 :]) if n > 0 else np.zeros(0, np.int64)
        keys, owner = (grams(w.hash, shingle)[at], w.doc[at]) if len(at) else (np.zeros(0, np.uint64), w.doc[:0])
        cuts = np.searchsorted(owner, np.arange(hi - lo + 1))
        for d in range(hi - lo):
            m = int(w.per_doc[d])
            first = int(w.first[d])
            out.append(np.unique(keys[cuts[d] : cuts[d + 1]]) if m >= shingle else grams(w.hash[first : first + m], m) if m else np.zeros(0, np.uint64))
    return out


def prefix_size(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Cells of a non-empty set of n."""
    return n - -(-percent * n // 100) + 1


def sketch(keys: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount((keys & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8)


def allowed(a: np.ndarray, b: np.ndarray, l1: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes and this least symmetric difference may link."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    return (100 * low >= percent * high) & ((100 + percent) * l1 <= (100 - percent) * (a + b))


def _l1(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(y)), np.int32)
    for c in range(x.shape[1]):
        out += np.abs(x[:, c][:, None] - y[:, c][None, :])
    return out


def region_pairs(vectors: np.ndarray, size: np.ndarray, rest: np.ndarray, label: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of the sets of a region that may link and differ in label, i < j.

    `rest`: shingles of each set from the cell's own on.  A pair's first common shingle is
    in a cell of both, and there the intersection is no larger than the lesser rest; so a
    cell may leave out pairs whose rests are too small."""
    x = vectors.astype(np.int16)
    coarse = x.reshape(len(x), 16, -1).sum(2).astype(np.int16)  # a quarter of the classes, a lesser distance
    _, which, n = np.unique(label, return_inverse=True, return_counts=True)
    few = np.flatnonzero(which != n.argmax())  # each pair has an end outside of the largest component
    every = np.arange(len(x))
    found = [(every[:0], every[:0], every[:0])]
    for lo in range(0, len(few), 512):
        h = few[lo : lo + 512]
        for at in range(0, len(every), 512):
            o = every[at : at + 512]
            may = allowed(size[h][:, None], size[o][None, :], _l1(coarse[h], coarse[o]), percent) & (which[h][:, None] != which[o][None, :])
            may &= (100 + percent) * np.minimum(rest[h][:, None], rest[o][None, :]) >= percent * (size[h][:, None] + size[o][None, :])
            i, j = np.nonzero(may)
            i, j = np.minimum(h[i], o[j]), np.maximum(h[i], o[j])
            for part in range(0, len(i), 100_000):
                a, b = i[part : part + 100_000], j[part : part + 100_000]
                d = np.abs(x[a] - x[b]).sum(1, dtype=np.int64)
                ok = allowed(size[a], size[b], d, percent)
                found.append((a[ok], b[ok], d[ok]))
    i, j, d = (np.concatenate(z) for z in zip(*found, strict=True))
    _, first = np.unique(i * len(x) + j, return_index=True)
    return i[first], j[first], d[first]


def spanning_forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Places of the links of a least spanning forest of the labels (Boruvka's rounds)."""
    comp = np.unique(label, return_inverse=True)[1]
    order = np.lexsort((b, a, weight))
    a, b = a[order], b[order]
    live, chosen = np.arange(len(a)), []
    while True:
        x, y = comp[a[live]], comp[b[live]]
        live = live[x != y]
        if not len(live):
            return order[np.unique(np.concatenate(chosen))] if chosen else np.zeros(0, np.int64)
        x, y = comp[a[live]], comp[b[live]]
        best = np.full(len(comp), len(a))
        np.minimum.at(best, x, live)
        np.minimum.at(best, y, live)
        pick = np.unique(best[best < len(a)])
        chosen.append(pick)
        root = np.arange(len(comp))
        u, v = comp[a[pick]], comp[b[pick]]
        while True:
            low = np.minimum(root[u], root[v])
            before = root.copy()
            np.minimum.at(root, root[u], low)
            np.minimum.at(root, root[v], low)
            while (root[root] != root).any():
                root = root[root]
            if (root == before).all():
                break
        comp = root[comp]


def _texts(t: pa.Table, text_col: str, rows: np.ndarray | None = None) -> list[bytes]:
    column = t.column(text_col).cast(pa.binary())
    return [b"" if x is None else x for x in (column if rows is None else column.take(pa.array(rows))).to_pylist()]


def jaccard_components(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, leaf: int = LEAF) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest id reachable
    by links, itself included).

    Null texts and texts without words have the empty set and link with nothing.  Repeated
    rows and equal texts link.  A null id is never the smallest.  Other columns are
    ignored; an empty table gives no rows.  Regions of over `leaf` sets are split.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    store, solved = _solve(rows, "doc_id", "text", percent, shingle, chunk_bytes, leaf)
    store.drop()
    return solved.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, leaf: int = LEAF) -> DataFrame:
    """`docs` with one row of each component, that of the smallest id (ids that are null
    last); rows with the empty set all stay."""
    store, solved = _solve(docs, id_col, text_col, percent, shingle, chunk_bytes, leaf)
    first = solved.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid", "chunk")).alias("least")).select("least.chunk", "least.uid")
    kept = solved.where("label is null").select("chunk", "uid").union(first)
    lists = kept.groupBy("chunk").agg(F.collect_list("uid").alias("uids"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, uids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = read_chunk(blob)
                rows = np.flatnonzero(np.isin(t.column(UID).to_numpy(), np.array(uids, np.int64)))
                for lo in range(0, len(rows), 2000):
                    yield from t.drop_columns([UID]).take(pa.array(rows[lo : lo + 2000])).combine_chunks().to_batches()

    return store.df.select("chunk", "blob").join(lists, "chunk").select("blob", "uids").mapInArrow(read, docs.schema)


#: The row number that a chunk store adds; the name is kept for it.
UID = "_tidelog_uid"


def _solve(docs: DataFrame, id_col: str, text_col: str, percent: int, shingle: int, chunk_bytes: int, leaf: int) -> tuple[Saved, DataFrame]:
    """The chunk store of `docs` with a row number, and for each row chunk, uid, doc_id,
    n_shingles, label (of its component; null for the empty set) and component_id."""
    kind = docs.schema[id_col].dataType.simpleString()
    store = chunks(docs.withColumn(UID, F.monotonically_increasing_id()), chunk_bytes, text_col, "sets")
    chunked = store.df.select("chunk", "blob")
    total = store.df.agg(F.sum("n_bytes")).first()[0] or 0
    bits = power_of_two(total / BUCKET_BYTES, 128, 1 << 20).bit_length() - 1
    part = "chunk long, bucket int, blob binary"

    def opened(blob: bytes) -> tuple[pa.Table, list[np.ndarray], list[bytes | None], np.ndarray, np.ndarray]:
        """Rows of a chunk, their sets and the sets' digests, the rows that stand for a set (least
        row number), and these sets' distinct shingles."""
        claim("groups")
        t = read_chunk(blob)
        sets = shingle_sets(_texts(t, text_col), shingle)
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        uid, seen = t.column(UID).to_numpy(), {}
        for i, d in enumerate(digests):
            if d is not None and (d not in seen or uid[i] < uid[seen[d]]):
                seen[d] = i
        own = np.array(sorted(seen.values()), np.int64)
        return t, sets, digests, own, np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in own)])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key, n = np.unique(opened(blob)[4], return_counts=True)
                bucket, low = (key >> np.uint64(64 - bits)).astype(np.int32), (key << np.uint64(bits)) >> np.uint64(24)
                cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(key)] if len(key) else [0]
                cuts = list(zip(cuts[:-1], cuts[1:], strict=True))
                blobs = [pack(np.diff(low[lo:hi], prepend=np.uint64(0)), np.minimum(n[lo:hi], 255).astype(np.uint8)) for lo, hi in cuts]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(cuts), pa.int64()), pa.array([int(bucket[lo]) for lo, _ in cuts], pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "bucket", "blob"])

    def answer(bucket: object, t: pa.Table) -> Iterator[pa.RecordBatch]:
        """How common each shingle is: 0 in one set, else by the logarithm of their number."""
        got = [unpack(x) for x in t.column("blob").to_pylist()]
        sizes = [len(x[0]) for x in got]
        low = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in got])
        order = np.argsort(low, kind="stable")
        low = low[order]
        firsts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        sums = np.add.reduceat(np.concatenate([x[1] for x in got])[order].astype(np.int64), firsts)
        said = np.empty(len(low), np.uint8)
        said[order] = np.repeat(np.minimum(4 * np.log2(sums), 255).astype(np.uint8), np.diff(np.append(firsts, len(low))))
        ends = np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays([t.column("chunk").combine_chunks(), t.column("bucket").combine_chunks(), pa.array([zstandard.compress(said[e - s : e].tobytes(), 3) for e, s in zip(ends, sizes, strict=True)], pa.binary())], names=["chunk", "bucket", "blob"])

    asked = chunked.mapInArrow(ask, part)
    answers = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(by_group(["chunk", "bucket", "blob"], "bucket", answer), part)
    lists = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "blob")).alias("answers"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, without a key; then one for each cell of each distinct set."""
        for b in batches:
            for chunk, blob, said in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                t, sets, digests, own, every = opened(blob)
                uid, sizes = t.column(UID).to_numpy(), np.array([len(s) for s in sets], np.int64)
                none = [None] * len(sets)
                names = ["chunk", "uid", "doc_id", "size", "digest", "key", "rest"]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(sets), pa.int64()), t.column(UID).chunk(0), t.column(id_col).chunk(0), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(none, pa.int64()), pa.array(none, pa.int64())], names=names)
                if not len(own):
                    continue
                common = np.frombuffer(b"".join(zstandard.decompress(x["blob"]) for x in sorted(said, key=lambda x: x["bucket"])), np.uint8)
                common = common[np.unique(every, return_inverse=True)[1]]
                n = sizes[own]
                owner = np.repeat(np.arange(len(own)), n)
                alone = np.bincount(owner, common == 0, len(own)).astype(np.int64)
                cells = prefix_size(n, percent)
                may = (alone < cells)[owner] & (common > 0)
                owner, common, key = owner[may], common[may], every[may]
                order = np.lexsort((key, common, owner))
                owner, key = owner[order], key[order]
                rank = alone[owner] + np.arange(len(owner)) - np.searchsorted(owner, owner)
                ok = rank < cells[owner]
                owner, key, rank = owner[ok], key[ok], rank[ok]
                for lo in range(0, len(owner), 20_000):
                    o = owner[lo : lo + 20_000]
                    rows = own[o]
                    yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(o), pa.int64()), pa.array(uid[rows]), pa.nulls(len(o), t.schema.field(id_col).type), pa.array(n[o]), pa.array([digests[i] for i in rows], pa.binary()), pa.array(key[lo : lo + 20_000].view(np.int64)), pa.array(n[o] - rank[lo : lo + 20_000])], names=names)

    placed = save(chunked.join(lists, "chunk", "left").select("chunk", "blob", "answers").mapInArrow(place, f"chunk long, uid long, doc_id {kind}, size long, digest binary, key long, rest long"), "placed").df
    listed = placed.where("key is null").select("chunk", "uid", "doc_id", F.col("size").alias("n_shingles"), "digest")
    nodes = placed.where("key is not null").groupBy("key", "digest").agg(F.min(F.struct("uid", "chunk")).alias("least"), F.max("size").alias("size"), F.max("rest").alias("rest"))
    held = save(nodes.select("key", "least.uid", "least.chunk", "size", "rest"), "held")
    several = held.df.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    live = save(held.df.join(several, "key"), "live")
    held.drop()
    temporary = [live]

    # the sets of live documents, read from their chunks
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, uids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = read_chunk(blob)
                rows = np.flatnonzero(np.isin(t.column(UID).to_numpy(), np.array(uids, np.int64)))
                for lo in range(0, len(rows), 1000):
                    some = rows[lo : lo + 1000]
                    sets = shingle_sets(_texts(t, text_col, some), shingle)
                    yield pa.RecordBatch.from_arrays([pa.array(t.column(UID).to_numpy()[some]), pa.array([sketch(s).tobytes() for s in sets], pa.binary()), pa.array([pack(np.diff(s, prepend=np.uint64(0))) for s in sets], pa.binary())], names=["uid", "vector", "keys"])

    wanted = live.df.select("chunk", "uid").distinct().groupBy("chunk").agg(F.collect_list("uid").alias("uids"))
    sets = save(chunked.join(wanted, "chunk").select("blob", "uids").mapInArrow(fetch, "uid long, vector binary, keys binary"), "sets")
    temporary.append(sets)

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far, links = [], []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = (np.cumsum(unpack(z)[0], dtype=np.uint64) for z in (x, y))
                shared = len(np.intersect1d(p, q, assume_unique=True))
                far.append(1 - shared / (len(p) + len(q) - shared))
                links.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(far, pa.float64()), pa.array(links, pa.bool_())], names=["u", "v", "far", "link"])

    def measure(pairs: DataFrame) -> DataFrame:
        """The Jaccard distance of each pair (u, v), and whether it links."""
        of_u, of_v = (sets.df.select(F.col("uid").alias(c), F.col("keys").alias(k)) for c, k in (("u", "x"), ("v", "y")))
        done = save(pairs.join(of_u, "u").join(of_v, "v").select("u", "v", "x", "y").mapInArrow(intersect, "u long, v long, far double, link boolean"), "measured")
        temporary.append(done)
        return done.df

    tested = labels = None

    def learn(checked: DataFrame) -> None:
        """Takes in what was measured: labels are of components so far."""
        nonlocal tested, labels
        tested = checked.select("u", "v") if tested is None else tested.union(checked.select("u", "v"))
        links = checked.where("link").select(F.col("u").alias("a"), F.col("v").alias("b"))
        if not links.take(1):
            return
        if labels is not None:  # components so far, as links
            links = links.union(labels.select("uid", "label"))
        labels = components(links, "sets").select(F.col("node").alias("uid"), F.col("component").alias("label"))

    def mixed(rows: DataFrame) -> DataFrame:
        """Rows (region, uid, size, rest) of regions that hold several components, with label and n, their number."""
        rows = rows.select("region", "uid", "size", "rest")
        rows = rows.withColumn("label", F.col("uid")) if labels is None else rows.join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
        several = rows.groupBy("region").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("region", "n")
        return rows.join(several, "region").select("region", "uid", "size", "rest", "label", "n")

    def pair(a: str, b: str) -> list:
        return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]

    # recursion: regions of document pivots, while there are regions over a leaf
    window = 2 * (1 - percent / 100) + 1e-9
    left, leaves, rigid = live.df.withColumnRenamed("key", "region"), [], []
    for depth in range(DEPTH):
        level = save(mixed(left), "level")
        temporary.append(level)
        leaves.append(level.df.where(F.col("n") <= leaf))
        large = level.df.where(F.col("n") > leaf)
        if not large.take(1):
            break
        draw = large.withColumn("slot", F.pmod(F.xxhash64("uid", F.lit(depth)), F.lit(PIVOTS)))
        pivots = save(draw.groupBy("region", "slot").agg(F.min(F.struct(F.xxhash64("uid", F.lit(-1 - depth)), "uid")).alias("p")).select("region", F.col("p.uid").alias("pivot")), "pivots")
        temporary.append(pivots)
        spread = large.join(pivots.df, "region")
        checked = measure(spread.where("uid <> pivot").select(*pair("uid", "pivot")).distinct())
        learn(checked)
        large = mixed(large)
        to = large.join(pivots.df, "region").select("region", "uid", "size", "rest", "n", "pivot", *pair("uid", "pivot")).join(checked.select("u", "v", "far").hint("merge"), ["u", "v"], "left").withColumn("far", F.when(F.col("uid") == F.col("pivot"), 0.0).otherwise(F.col("far")))
        to = save(to.drop("u", "v"), "spread")
        temporary.append(to)
        near = to.df.groupBy("region", "uid").agg(F.min("far").alias("near"))
        inside = to.df.join(near.hint("merge"), ["region", "uid"]).where(F.col("far") <= F.col("near") + window)
        parts = inside.groupBy("region", "pivot").agg(F.count("*").alias("m"), F.first("n").alias("n"))
        split = parts.groupBy("region").agg(F.max(F.col("m") / F.col("n")).alias("most")).where("most <= 0.7").select("region")
        left = inside.join(split, "region").select(F.xxhash64("region", "pivot", F.lit(depth)).alias("region"), "uid", "size", "rest")
        rigid.append(to.df.select("region", "uid", "size", "rest").distinct().join(split, "region", "left_anti"))
    else:
        level = save(mixed(left), "level")
        temporary.append(level)
        leaves.append(level.df.where(F.col("n") <= leaf))
        rigid.append(level.df.where(F.col("n") > leaf))

    def cut_by_size() -> DataFrame:
        """Regions that pivots can't split: classes of sizes (partners are in neighbouring ones),
        and in a class blocks of the largest component's sets against blocks of the others."""
        rows = rigid[0].select("region", "uid", "size", "rest")
        for more in rigid[1:]:
            rows = rows.union(more.select("region", "uid", "size", "rest"))
        size_class = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.001 / percent))).cast("int")
        rows = mixed(rows.withColumn("class", F.explode(F.array(size_class, size_class + 1))).withColumn("region", F.xxhash64("region", "class")))
        per = rows.groupBy("region", "label").agg(F.count("*").alias("m"))
        most = per.groupBy("region").agg(F.max(F.struct("m", "label")).alias("most"), F.sum("m").alias("all"))
        most = most.select("region", F.col("most.label").alias("top"), F.ceil(F.col("most.m") / leaf).cast("int").alias("tops"), F.ceil((F.col("all") - F.col("most.m")) / leaf).cast("int").alias("others"))
        rows = rows.join(most, "region").withColumn("is_top", F.col("label") == F.col("top"))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("uid"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("others"))).cast("int"))
        met = F.when(F.col("is_top"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("tops") - 1))
        across = rows.withColumn("other", F.explode(met)).withColumn("region", F.xxhash64("region", F.lit("across"), F.when(F.col("is_top"), F.col("block")).otherwise(F.col("other")), F.when(F.col("is_top"), F.col("other")).otherwise(F.col("block"))))
        among = rows.where("not is_top").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).withColumn("region", F.xxhash64("region", F.lit("among"), F.least("block", "other"), F.greatest("block", "other")))
        return across.select("region", "uid", "size", "rest").union(among.select("region", "uid", "size", "rest"))

    def compare(t: pa.Table, forest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of whole regions, rows sorted by region.  Small regions are compared
        together, each row with those up to SMALL - 1 places on; large ones one by one."""
        region, uid, label, size, rest = (t.column(c).to_numpy() for c in ("region", "uid", "label", "size", "rest"))
        x = np.frombuffer(b"".join(t.column("vector").to_pylist()), np.uint8).reshape(-1, CLASSES)
        starts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
        n = np.diff(np.append(starts, len(region)))
        few = np.flatnonzero(np.repeat(n <= SMALL, n))
        for k in range(1, SMALL):
            i, j = few[:-k], few[k:]
            ok = (region[i] == region[j]) & (label[i] != label[j])
            ok &= (100 + percent) * np.minimum(rest[i], rest[j]) >= percent * (size[i] + size[j])
            i, j = i[ok], j[ok]
            ok = allowed(size[i], size[j], np.abs(x[i].astype(np.int16) - x[j]).sum(1, dtype=np.int64), percent)
            yield uid[i[ok]], uid[j[ok]]
        for lo, m in zip(starts[n > SMALL].tolist(), n[n > SMALL].tolist(), strict=True):
            own = slice(lo, lo + m)
            i, j, d = region_pairs(x[own], size[own], rest[own], label[own], percent)
            i, j = i + lo, j + lo
            if forest and len(i):
                pick = spanning_forest(i - lo, j - lo, d / (size[i] + size[j]), label[own])
                i, j = i[pick], j[pick]
            yield uid[i], uid[j]

    def region(forest: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("groups")
            held = None
            for b in chain(batches, [None]):
                t = pa.Table.from_batches([b]) if b is not None else None
                whole = pa.concat_tables([x for x in (held, t) if x is not None]) if held is not None or t is not None else None
                held = None
                if whole is None or not len(whole):
                    continue
                if b is not None:  # the last region may go on
                    key = whole.column("region").to_numpy()
                    cut = int(np.searchsorted(key, key[-1], "left"))
                    held, whole = whole.slice(cut), whole.slice(0, cut)
                if not len(whole):
                    continue
                for u, v in compare(whole, forest):
                    low, high = np.minimum(u, v), np.maximum(u, v)
                    for lo in range(0, len(low), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(low[lo : lo + 50_000]), pa.array(high[lo : lo + 50_000])], names=["u", "v"])

        return run

    # a fixed number of partitions: regions are small in bytes and large in work
    parts = shuffle_partitions(docs.sparkSession)
    pool = leaves[0]
    for more in leaves[1:]:
        pool = pool.union(more)
    pool = pool.select("region", "uid", "size", "rest")
    if rigid:
        cut = save(cut_by_size(), "cut")
        temporary.append(cut)
        pool = pool.union(cut.df)
    vectors = sets.df.select("uid", "vector")
    for forest in (True, False):
        rows = mixed(pool).join(vectors, "uid").select("region", "uid", "size", "rest", "label", "vector")
        found = rows.repartition(parts, "region").sortWithinPartitions("region").mapInArrow(region(forest), "u long, v long").distinct()
        if tested is not None:
            found = found.join(tested.hint("merge"), ["u", "v"], "left_anti")  # pairs pack well on disk: a size read there says little of memory
        pairs = save(found, "pairs")
        temporary.append(pairs)
        if pairs.df.take(1):
            learn(measure(pairs.df))

    classes = listed.where("digest is not null").groupBy("digest").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("least"))
    if labels is None:
        named = classes.withColumn("label", F.col("uid"))
    else:
        named = classes.join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    named = save(named, "named").df
    for done in temporary:
        done.drop()
    heads = named.groupBy("label").agg(F.min("least").alias("component_id"))
    per_class = named.join(heads, "label").select("digest", "label", "component_id")
    return store, listed.join(per_class, "digest", "left").select("chunk", "uid", "doc_id", "n_shingles", "label", "component_id")
