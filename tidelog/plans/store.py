"""A store of versioned JSON records: single calls, and batch forms for real work."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.text import encode, project_fields, tombstone, with_value
from tidelog.model import DELETE, LOG_SCHEMA, OPS_SCHEMA, SET, Options
from tidelog.operators import blocks, merge, oplog
from tidelog.sources.blocks import each
from tidelog.sources.storage import DirectoryStorage, Storage

#: Most keys that single calls hold on the driver; a larger store is asked by a query for each.
HELD_KEYS = 100_000
#: Batches whose views are laid over one another before the log is read again, single changes too,
#: and messages that on_error gets.
LAYERS, CHANGES, MESSAGES = 16, 10_000, 100


def stamped_text(record: str, id_: str, seq: int, rid: int) -> str:
    """A record's text with the four system fields: in their place if the caller has them,
    else at the end as id, _seq, _rid, _oid."""
    value = json.loads(record)
    value |= {"id": id_}
    value |= {"_seq": seq, "_rid": rid, "_oid": SET}
    return encode(value)


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sets get their texts; deletions have theirs."""
    for b in batches:
        columns = (b[c] for c in ("record", "id", "_seq", "_rid", "_oid"))
        yield b.assign(record=[r if o == DELETE else stamped_text(r, i, s, k) for r, i, s, k, o in zip(*columns, strict=True)])


class Store:
    """An open store.  Views are DataFrames; a commit makes new blocks and a new view, which is
    the one before and the batch, merged; the log is not read again.

    Single calls work on the driver while the store has at most HELD_KEYS keys, each change a
    line that is flushed to an open block; they are for small stores and few keys."""

    def __init__(self, spark: SparkSession, storage: Storage | None = None, **options: Any):
        self.spark = spark
        self.options = Options.of(options)
        self.opened = True
        self.storage = storage or DirectoryStorage(spark, self.options.dir_path)
        self.storage.ensure()
        self._base: DataFrame | None = None
        self._persisted: list[DataFrame] = []
        self._writer = None
        self._locked: set[str] = set()
        self._maintained = 0.0
        self._load()

    # state: _base is a view of committed rows; _changes holds the rows of single calls since it
    # was made; _held, if the store is small, has every key's row

    def _load(self) -> None:
        names = self.storage.blocks()
        if self.options.on_error:
            found = self.storage.load(names, strict=False)
            self.errors = found.where("error is not null").select("bid", "line_no", F.col("record").alias("line"), "error")
            for r in self.errors.orderBy("bid", "line_no").limit(MESSAGES).collect():
                self.options.on_error(r["error"])
            self.log = found.where("error is null").drop("error")
        else:
            self.errors = self.spark.createDataFrame([], "bid string, line_no long, line string, error string")
            self.log = self.storage.load(names)
        tops = {"_top_seq": F.col("_seq"), "_top_rid": F.col("_rid")}  # of all lines, so that they are read once
        self._view(merge.current(self.log.withColumns(tops), list(tops)), fresh=True)
        row = self._base.agg(*(F.max(c) for c in tops), F.count("*")).first()  # a bad line fails the opening
        self.seq, self.rid, self._size = (int(x or 0) for x in row)
        self._base = self._base.drop(*tops)

    def _view(self, base: DataFrame, fresh: bool = False) -> None:
        """A new view; with `fresh` it rests on the log alone."""
        old = self._persisted if fresh else []
        self._base = base.persist()
        self._persisted = [self._base] if fresh else [*self._persisted, self._base]
        self._changes: dict[str, tuple] = {}
        self._held: dict[str, tuple] | None = None
        for df in old:
            df.unpersist()

    def _check(self, id_: Any = "-") -> None:
        if not id_:
            raise ValueError("id is required")
        if not isinstance(id_, str):
            raise TypeError("id must be a string")
        if not self.opened:
            raise RuntimeError("Db should be opened before operation. Make sure you are not using a closed instance of Db.")

    def _rows(self) -> DataFrame:
        """One row for each key, tombstones included."""
        if not self._changes:
            return self._base
        changed = self.spark.createDataFrame(list(self._changes.values()), LOG_SCHEMA)  # at most CHANGES
        return self._base.join(F.broadcast(changed.select("id")), "id", "left_anti").unionByName(changed)

    def _find(self, id_: str) -> tuple | None:
        """The row of a key (LOG_SCHEMA), a tombstone too."""
        if id_ in self._changes:
            return self._changes[id_]
        if self._held is None and self._size <= HELD_KEYS:
            self._held = {r["id"]: tuple(r) for r in self._base.select(*_columns()).collect()}
        if self._held is not None:
            return self._held.get(id_)
        found = self._base.where(F.col("id") == id_).select(*_columns()).take(1)
        return tuple(found[0]) if found else None

    # views

    @property
    def current(self) -> DataFrame:
        """One row for each key, tombstones included; with cached_fields, `cache` has them."""
        self._check()
        out = self._rows()
        if not self.options.cached_fields:
            return out
        return with_value(out, "record").select(*out.columns, project_fields(F.col("_value"), self.options.cached_fields).alias("cache"))

    @property
    def live(self) -> DataFrame:
        return merge.live(self.current)

    # single calls

    def close(self) -> None:
        self._check()
        self._roll()
        for df in self._persisted:
            df.unpersist()
        self.opened = False

    def has(self, id_: str) -> bool:
        self._check(id_)
        row = self._find(id_)
        return row is not None and row[1] != DELETE

    def get(self, id_: str) -> dict[str, Any] | None:
        self._check(id_)
        row = self._find(id_)
        if row is None or row[1] == DELETE:
            return None
        value = json.loads(row[6])
        if not value.get("id"):
            raise RuntimeError("INTERNAL: id missing in value")
        if value["id"] != id_:
            raise RuntimeError("INTERNAL: id mismatch")
        return value

    def set(self, id_: str, value: dict[str, Any]) -> dict[str, Any]:
        """Replaces the record; returns it with its system fields.  `value` is not changed."""
        self._check(id_)
        row = self._find(id_)
        there = row is not None and (row[1] != DELETE or self.options.reload_rule)
        rid = row[2] if there else self.rid + 1
        text = stamped_text(encode(value), id_, self.seq + 1, rid)
        self._put(id_, SET, rid, text)
        return json.loads(text)

    def delete(self, id_: str) -> None:
        """Nothing happens where the key is not there."""
        self._check(id_)
        row = self._find(id_)
        if row is not None and row[1] != DELETE:
            self._put(id_, DELETE, row[2], encode({"id": id_, "_oid": DELETE, "_rid": row[2], "_seq": self.seq + 1}))

    def _put(self, id_: str, oid: int, rid: int, text: str) -> None:
        """Writes a line to the open block, or to a new one if there is none or it is full."""
        if self._writer is not None and (self._writer.size >= self.options.max_block_size or self._writer.name in self._locked):
            self._roll()
        if self._writer is None:
            self._writer, self._lines = self.storage.writer(self.seq + 1), 0
            self.storage.commit([self._writer.name])
        self._writer.write(text)
        self._lines += 1
        self.seq, self.rid = self.seq + 1, max(self.rid, rid)
        self._changes[id_] = (id_, oid, rid, self.seq, self._writer.name, self._lines, text)
        if len(self._changes) >= CHANGES and (self._held is None or self._size + len(self._changes) > HELD_KEYS):
            self._roll()
            self._load()

    def _roll(self) -> None:
        """Closes the open block."""
        if self._writer is not None:
            self._writer.close()
            self._writer = None

    # batch calls

    def has_many(self, keys: DataFrame, key: str = "id") -> DataFrame:
        self._check()
        return merge.has_many(self._rows(), keys, key)

    def get_many(self, keys: DataFrame, key: str = "id") -> DataFrame:
        self._check()
        return merge.get_many(self._rows(), keys, key)

    def apply(self, ops: DataFrame | list[tuple]) -> list[str]:
        """Applies sets and deletes in the order of `ord` and commits them, all or none; returns the
        new blocks.  Keys that are null or empty are refused."""
        self._check()
        self._roll()
        if isinstance(ops, list):
            ops = self.spark.createDataFrame(ops, OPS_SCHEMA)
        checked = F.when((F.col("id").isNull()) | (F.col("id") == ""), F.raise_error(F.lit("id is required")).cast("string")).otherwise(F.col("id"))
        ops = ops.withColumn("id", checked)
        rows = self._rows()
        known = rows if self.options.reload_rule else merge.live(rows)
        marked: list[DataFrame] = []
        stamped = oplog.stamp(ops, known, self.seq, self.rid, marked)
        gone = tombstone(F.col("id"), F.col("_rid"), F.col("_seq"))
        done = stamped.where(F.col("op").isin(SET, DELETE)).withColumn("record", F.when(F.col("op") == DELETE, gone).otherwise(F.col("record")))
        lines = done.select("id", "_seq", "_rid", "record", F.col("op").alias("_oid")).mapInPandas(_texts, "id string, _seq long, _rid long, record string, _oid int").persist()
        try:
            size = lines.agg(F.count("*").alias("n"), F.sum(F.octet_length("record") + 1).alias("bytes"), F.max("_seq").alias("seq"), F.max("_rid").alias("rid")).first()
            if not size["n"]:
                return []
            names = self.storage.append(lines, self.seq + 1, math.ceil(size["bytes"] / self.options.max_block_size))
            self.storage.commit(names)
            self._add(names)
        finally:
            for df in (lines, *marked):
                df.unpersist()
        self.seq, self.rid = max(self.seq, size["seq"]), max(self.rid, size["rid"])
        return names

    def _add(self, names: list[str]) -> None:
        """Lays new blocks over the view."""
        if len(self._persisted) >= LAYERS:
            self._load()
            return
        added = self.storage.load(names)
        self.log = self.log.unionByName(added)
        self._view(merge.merge_blocks(self._rows().unionByName(merge.last_lines(added))))
        self._size = self._base.count()

    # maintenance

    def blocks(self) -> DataFrame:
        """bid, size, live_chars, stale_bytes, locked: sizes in UTF-8 bytes, a newline for each line."""
        self._check()
        length = F.octet_length("record").cast("long") + 1
        locked = F.col("bid").isin(sorted(self._locked)) if self._locked else F.lit(False)
        return blocks.stale_bytes(self.storage.stats(), self._rows(), length).withColumn("locked", locked)

    def candidates(self) -> DataFrame:
        return blocks.candidates(self.blocks(), self.options.stale_data_threshold)

    def maintain(self, now: float | None = None) -> list[str]:
        """Compacts the blocks whose stale share reaches the threshold, if the last run is
        compact_delay ago; returns them.  Blocks that are locked are left out."""
        self._check()
        now = time.time() if now is None else now
        if (now - self._maintained) * 1000 < self.options.compact_delay:
            return []
        self._maintained = now
        self._roll()
        found = [r["bid"] for r in self.candidates().where("not locked").orderBy("bid").select("bid").collect()]  # names of blocks
        done = [bid for bid, taken in zip(found, each(self.storage.lock, found), strict=True) if taken]
        if done:
            self._compact(done)
        return done

    def compact(self, bid: str) -> None:
        """Writes the rows of a block that still count to a new one, which takes its place in one
        commit; the old file stays as `.old`."""
        self._check()
        if self._writer is not None and self._writer.name == bid:
            self._roll()
        if bid not in self.storage.blocks():
            raise KeyError("Block not found")
        if bid in self._locked or not self.storage.lock(bid):
            raise RuntimeError("Block is already locked")
        self._compact([bid])

    def _compact(self, bids: list[str]) -> None:
        """Compacts blocks that this store has locked, together, and frees them."""
        self._locked |= set(bids)
        try:
            others = sorted(set(self.storage.blocks()) - set(bids))
            if self.options.on_error:
                log = self.storage.load(others, strict=False).where("error is null").drop("error")
            else:
                log = self.storage.load(others)
            kept = blocks.compact(self._rows(), bids, log).persist()
            size = kept.agg(F.coalesce(F.min("_seq"), F.lit(0)).alias("first"), F.coalesce(F.sum(F.octet_length("record") + 1), F.lit(0)).alias("bytes")).first()
            made = self.storage.append(kept, int(size["first"]), max(1, math.ceil(size["bytes"] / self.options.max_block_size)), tag=f"c{self.seq}-{int(time.time() * 1000)}-")
            kept.unpersist()
            self.storage.commit(made, bids)
            each(lambda bid: self.storage.rename(bid, f"{bid}.old"), bids)
            self._load()
        finally:
            self._locked -= set(bids)
            each(self.storage.unlock, bids)

    def unlock(self, bid: str) -> None:
        """Frees a block that a crashed compaction has left locked."""
        self.storage.unlock(bid)


def _columns() -> list[str]:
    return [c.split()[0] for c in LOG_SCHEMA.split(", ")]


def open_store(spark: SparkSession, **options: Any) -> Store:
    return Store(spark, **options)
