"""Sizes of blocks, stale bytes, packing and compaction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.text import utf8_length, utf16_length
from tidelog.model import LARGEST_INTEGER

#: Most blocks that a filter names.
NAMED = 32


def sequence_stats(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Largest and smallest _seq and _rid; 0 and 2^53 - 1 of no rows.  By block if asked."""
    stats = [
        F.coalesce(F.max("_seq"), F.lit(0)).cast("long").alias("max_seq"), F.coalesce(F.min("_seq"), F.lit(LARGEST_INTEGER)).cast("long").alias("min_seq"),
        F.coalesce(F.max("_rid"), F.lit(0)).cast("long").alias("max_rid"), F.coalesce(F.min("_rid"), F.lit(LARGEST_INTEGER)).cast("long").alias("min_rid"),
    ]
    return rows.groupBy(by).agg(*stats) if by else rows.agg(*stats)


def block_sizes(log: DataFrame) -> DataFrame:
    """Bytes of each block: its lines in UTF-8 and a newline for each."""
    return log.groupBy("bid").agg(F.sum(utf8_length(F.col("record")) + 1).alias("size"))


def stale_bytes(sizes: DataFrame, current: DataFrame, length: Column | None = None) -> DataFrame:
    """bid, size, live_chars and stale_bytes (size less live_chars; all of a block without
    current rows).  `length` measures a record, in UTF-16 units unless given."""
    live = current.groupBy("bid").agg(F.sum(utf16_length(F.col("record")) if length is None else length).alias("live_chars"))
    joined = sizes.join(live, "bid", "left").withColumn("live_chars", F.coalesce("live_chars", F.lit(0)).cast("long"))
    return joined.select("bid", F.col("size").cast("long").alias("size"), "live_chars", (F.col("size") - F.col("live_chars")).cast("long").alias("stale_bytes"))


def stale_delta(changes: DataFrame) -> DataFrame:
    """What a batch adds to blocks.  `changes`: new_bid, new_length, old_bid and old_length
    (null where the key was not there)."""
    none = F.lit(0).cast("long")
    new = F.struct(F.col("new_bid").alias("bid"), F.col("new_length").cast("long").alias("size"), none.alias("stale"))
    old = F.struct(F.col("old_bid").alias("bid"), none.alias("size"), F.col("old_length").cast("long").alias("stale"))
    both = changes.select(F.inline(F.array(new, old))).where("bid is not null")  # one reading of the changes gives both sides
    return both.groupBy("bid").agg(F.sum("size").cast("long").alias("size_added"), F.sum("stale").cast("long").alias("stale_added"))


def candidates(blocks: DataFrame, threshold: float) -> DataFrame:
    """Blocks whose stale share reaches the threshold."""
    return blocks.where((F.col("size") > 0) & (F.col("stale_bytes") / F.col("size") >= threshold))


def free_block(blocks: DataFrame, last_used: int, most: int) -> DataFrame:
    """One row: the index and bid of the block to write to next, nulls if it is a new one.

    `blocks`: index (from 0, gapless), bid, size, locked.  The block that was used last is taken
    if it is unlocked and below `most`, else the first such one after it, and none before it; an index
    that is no block's counts as 0.  The size is looked at before a write, so blocks overshoot."""
    free = ~F.col("locked") & (F.col("size") < most)

    def first(start: int) -> Column:
        return F.min(F.when(free & (F.col("index") >= start), F.struct("index", "bid")))

    known = F.count("*") > last_used if last_used >= 0 else F.lit(False)
    found = blocks.agg(F.when(known, first(max(last_used, 0))).otherwise(first(0)).alias("found"))
    return found.select(F.col("found.index").alias("index"), F.col("found.bid").alias("bid"))


def pack(rows: DataFrame, order: str, size: str, most: int, group: str | None = None) -> DataFrame:
    """Adds `block`, from 0: a row opens a block when the one before has reached `most`.

    The rule looks at what a block holds so far, so it is one pass in order; streams of
    rows that are packed apart (`group`; null is a stream of its own) go to tasks of their own.
    Only order and size enter the pass, in chunks of bounded memory, and it moves from
    block to block by search in running sums, not from row to row.  Null sizes count as 0.
    """
    slim = rows.select(*([group] if group else []), order, size)
    names = slim.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, last = 0, 0, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            sizes = pc.fill_null(b.column(names.index(size)).cast(pa.int64()), 0).to_numpy()
            out = np.empty(n, np.int64)
            stream = b.column(0).dictionary_encode("encode") if group else pa.array(np.zeros(n, np.int8)).dictionary_encode()
            code = stream.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), n]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                now = (stream.dictionary[int(code[lo])].as_py(),)
                if now != last:
                    block, held, last = 0, 0, now
                ends = np.cumsum(sizes[lo:hi])
                at = 0
                while lo + at < hi:
                    if held >= most:
                        block, held = block + 1, 0
                    before = int(ends[at - 1]) if at else 0
                    # the first row with which the block reaches `most` is its last
                    stop = min(int(np.searchsorted(ends, before + most - held, "left")) + 1, hi - lo)
                    stop = max(stop, at + 1)
                    out[lo + at : lo + stop] = block
                    held += int(ends[stop - 1]) - before
                    at = stop
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*names, "block"])

    dealt = slim.repartition(group).sortWithinPartitions(group, order) if group else slim.coalesce(1).sortWithinPartitions(order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
    return dealt.mapInArrow(fold, f"{schema}, block long")


def compact(current: DataFrame, bids: str | list[str], log: DataFrame | None = None) -> DataFrame:
    """Rows that a block, or several together, keep, with new line numbers in each in _seq order.

    A tombstone stays while an older version of its key lies in another block of `log`."""
    bids = [bids] if isinstance(bids, str) else bids

    def of(rows: DataFrame, theirs: bool) -> DataFrame:
        """Rows in these blocks, or in others; many names are joined."""
        if len(bids) <= NAMED:
            return rows.where(F.col("bid").isin(bids) if theirs else ~F.col("bid").isin(bids))
        names = rows.sparkSession.createDataFrame([(b,) for b in bids], "bid string").distinct()
        return rows.join(F.broadcast(names), "bid", "left_semi" if theirs else "left_anti").select(*rows.columns)

    own = of(current, True)
    if log is not None:
        older = of(log, False).select("id").distinct().withColumn("_older", F.lit(True))
        own = own.join(older, "id", "left").where("_oid <> 2 or _older").drop("_older")
    return own.withColumn("line_no", F.row_number().over(Window.partitionBy("bid").orderBy("_seq")).cast("long"))
