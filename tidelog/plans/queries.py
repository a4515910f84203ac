"""Registered queries over the test tables, one for each operator of the record store."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import cells
from tidelog.functions.text import base36, project_fields, split_part, tombstone, utf8_length, utf16_length, with_error, with_value
from tidelog.model import DELETE, OPS_SCHEMA, SET
from tidelog.operators import bitset, blocks, merge, oplog, sorted_index
from tidelog.sources.blocks import number_lines, parse_lines
from tidelog.sources.storage import shared_place

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a change log: user_id is the key, event_id the order, `error` deletes."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"), F.when(F.col("event_type") == "error", DELETE).otherwise(SET).alias("_oid"),
        F.col("event_id").alias("_seq"), F.expr("event_id div 1000").cast("string").alias("bid"), F.col("event_id").alias("line_no"), F.col("props").alias("record"),
    )


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).select(F.col("_seq").alias("ord"), "id", F.col("_oid").alias("op"), "bid", "record")


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.best(log(spark, sf_dir), ["id"], F.col("_seq"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.stamp(ops(spark, sf_dir))


def stamped_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stamped(spark, sf_dir).select("id", F.col("op").alias("_oid"), "_seq", "_rid", "bid", "record")
    return merge.best(rows, ["id"], F.col("_seq"))


@query
def kv_live(spark, sf_dir):
    return merge.live(current(spark, sf_dir)).select("id", F.col("_seq").alias("seq"), "record")


@query
def kv_get(spark, sf_dir):
    return merge.live(current(spark, sf_dir)).where("id = '7'").select("id", F.col("_seq").alias("seq"), "record")


@query
def kv_multi_get(spark, sf_dir):
    return merge.get_many(current(spark, sf_dir), customers(spark, sf_dir)).select("id", F.col("_seq").alias("seq"), "record")


@query
def kv_has(spark, sf_dir):
    return merge.has_many(current(spark, sf_dir), customers(spark, sf_dir))


@query
def kv_missing(spark, sf_dir):
    return merge.missing(current(spark, sf_dir), customers(spark, sf_dir))


@query
def kv_get_by_rid(spark, sf_dir):
    """The live record of the largest surrogate key that one has."""
    rows = stamped_current(spark, sf_dir)
    rid = merge.live(rows).agg(F.max("_rid")).first()[0]
    return merge.get_by_rid(rows, rid or 0).select("id", F.col("_rid").alias("rid"), F.col("_seq").alias("seq"), "record")


@query
def rid_conflicts(spark, sf_dir):
    """Part keys as ids, brands' lengths as surrogate keys, so that there are conflicts."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("_rid")).distinct()
    return merge.rid_conflicts(rows).select(F.col("_rid").alias("rid"), "n")


@query
def live_filter(spark, sf_dir):
    return merge.live(current(spark, sf_dir)).select("id", F.col("_oid").alias("oid"), F.col("_seq").alias("seq"))


@query
def tombstones(spark, sf_dir):
    return merge.tombstones(current(spark, sf_dir)).select("id", F.col("_oid").alias("oid"), F.col("_seq").alias("seq"))


@query
def oplog_assign(spark, sf_dir):
    return stamped(spark, sf_dir).select("ord", "id", "op", F.col("_seq").alias("seq"), F.col("_rid").alias("rid"))


@query
def oplog_delete(spark, sf_dir):
    rows = oplog.deletes(stamped(spark, sf_dir))
    return rows.select("ord", "id", F.col("_seq").alias("seq"), F.col("_rid").alias("rid"), tombstone(F.col("id"), F.col("_rid"), F.col("_seq")).alias("record"))


def _lines(spark, sf_dir) -> DataFrame:
    """events as the lines of block files, the properties inside the record."""
    n = F.col("line_no").cast("string")
    text = F.concat(F.lit('{"id":"'), F.col("id"), F.lit('","_oid":'), F.col("_oid").cast("string"), F.lit(',"_rid":'), n, F.lit(',"_seq":'), n, F.lit(',"props":'), F.col("record"), F.lit("}"))
    return log(spark, sf_dir).select("bid", "line_no", text.alias("line"))


@query
def parse_block(spark, sf_dir):
    return parse_lines(_lines(spark, sf_dir)).select("bid", "line_no", "id", F.col("_oid").alias("oid"), F.col("_rid").alias("rid"), F.col("_seq").alias("seq"), "record")


@query
def oplog_existing(spark, sf_dir):
    """Two batches, the second against what the first has left."""
    rows = ops(spark, sf_dir)
    half = rows.agg((F.max("ord") / 2).cast("long")).first()[0]
    first = oplog.stamp(rows.where(F.col("ord") <= half))
    seq, rid = first.agg(F.coalesce(F.max("_seq"), F.lit(0)), F.coalesce(F.max("_rid"), F.lit(0))).first()
    known = merge.live(merge.best(first.select("id", F.col("op").alias("_oid"), "_seq", "_rid"), ["id"], F.col("_seq")))
    second = oplog.stamp(rows.where(F.col("ord") > half), known, seq, rid)
    return first.union(second.select(*first.columns)).select("ord", "id", "op", F.col("_seq").alias("seq"), F.col("_rid").alias("rid"))


@query
def load_block(spark, sf_dir):
    rows = merge.last_lines(parse_lines(_lines(spark, sf_dir)))
    return rows.select("bid", "id", "line_no", F.col("_oid").alias("oid"), F.col("_seq").alias("seq"), "record")


@query
def error_rows(spark, sf_dir):
    """What a store with on_error leaves out."""
    lines = table(spark, sf_dir, "events").select(F.lit("b").alias("bid"), F.col("event_id").alias("line_no"), _odd_record().alias("line"))
    return parse_lines(lines, strict=False).where("error is not null").select("line_no", "error")


@query
def merge_latest(spark, sf_dir):
    disordered = log(spark, sf_dir).withColumn("bid", (F.col("line_no") % 8).cast("string")).withColumn("_seq", F.col("line_no") * 7919 % 997)
    return merge.current(disordered).select("id", "bid", F.col("_seq").alias("seq"), "line_no", F.col("_oid").alias("oid"))


@query
def seq_stats(spark, sf_dir):
    return blocks.sequence_stats(stamped_current(spark, sf_dir))


@query
def seq_stats_by_block(spark, sf_dir):
    return blocks.sequence_stats(stamped(spark, sf_dir), "bid")


@query
def stale_bytes(spark, sf_dir):
    rows = log(spark, sf_dir)
    return blocks.stale_bytes(blocks.block_sizes(rows), current(spark, sf_dir))


@query
def stale_delta(spark, sf_dir):
    by_key = Window.partitionBy("id").orderBy("ord")
    text = F.when(F.col("op") == DELETE, tombstone(F.col("id"), F.col("_rid"), F.col("_seq"))).otherwise(F.col("record"))
    rows = stamped(spark, sf_dir).withColumn("length", utf16_length(text))
    before = F.lag(F.struct("op", "bid", "length")).over(by_key)
    changes = rows.select(F.col("bid").alias("new_bid"), F.col("length").alias("new_length"), before.alias("before"))
    old = F.when(F.col("before.op") == SET, F.col("before"))
    return blocks.stale_delta(changes.select("new_bid", "new_length", old["bid"].alias("old_bid"), old["length"].alias("old_length")))


@query
def compaction_candidates(spark, sf_dir):
    return blocks.candidates(stale_bytes(spark, sf_dir), 0.4).select("bid", "size", "stale_bytes")


@query
def compact_block(spark, sf_dir):
    """The middle one of the blocks that have current rows: a tombstone stays only where an
    older version of its key lies in another block."""
    rows = log(spark, sf_dir).withColumn("bid", (F.col("line_no") % 8).cast("string"))
    return blocks.compact(merge.current(rows), "4", rows).select("bid", "id", "line_no", F.col("_oid").alias("oid"), "record")


@query
def block_pack_whole(spark, sf_dir):
    """One stream."""
    return blocks.pack(table(spark, sf_dir, "conversations").select(F.expr("conv_id * 1000 + turn").alias("ord"), F.octet_length("text").cast("long").alias("size")), "ord", "size", 2000)


def _store(spark, sf_dir, name, **options):
    """A store in the shared folder that events have been applied to in two batches, opened again."""
    from tidelog.plans.store import open_store

    at = f"{shared_place(spark)}/store-{name}-{uuid.uuid4().hex}"
    db = open_store(spark, dir_path=at, max_block_size=64 * 1024, **options)
    rows = ops(spark, sf_dir).select(*(c.split()[0] for c in OPS_SCHEMA.split(", ")))
    half = rows.agg((F.max("ord") / 2).cast("long")).first()[0]
    for part in (rows.where(F.col("ord") <= half), rows.where(F.col("ord") > half)):
        db.apply(part)
    db.close()
    return open_store(spark, dir_path=at, max_block_size=64 * 1024, **options)


@query
def store_open(spark, sf_dir):
    """Append, commit, open, block scan, parse and merge: what a reopened store holds."""
    db = _store(spark, sf_dir, "open", cached_fields=["k"])
    return db.live.select("id", F.col("_seq").alias("seq"), F.col("_rid").alias("rid"), F.element_at("cache", "k").alias("k"))


@query
def store_compact(spark, sf_dir):
    """The same, after compaction by threshold and another opening."""
    db = _store(spark, sf_dir, "compact", stale_data_threshold=0.2)
    db.maintain()
    at = db.options.dir_path
    db.close()
    from tidelog.plans.store import open_store

    return open_store(spark, dir_path=at).live.select("id", F.col("_seq").alias("seq"), F.col("_rid").alias("rid"))


@query
def store_records(spark, sf_dir):
    """Texts as they are stored."""
    return _store(spark, sf_dir, "records").live.select("id", "record")


@query
def store_sizes(spark, sf_dir):
    """Listing, sizes, live and stale bytes of the block files, over all of them."""
    found = _store(spark, sf_dir, "sizes").blocks()
    return found.agg(*(F.sum(c).alias(c) for c in ("size", "live_chars", "stale_bytes")))


@query
def free_block(spark, sf_dir):
    """Suppliers as blocks, every third one locked, the fourth used last."""
    rows = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") - F.lit(1)).alias("index"), F.col("s_name").alias("bid"), (F.col("s_suppkey") * 37 % 100).alias("size"), (F.col("s_suppkey") % 3 == 0).alias("locked"))
    return blocks.free_block(rows, 3, 40)


@query
def store_lookups(spark, sf_dir):
    """has and get for a table of keys."""
    db = _store(spark, sf_dir, "lookups")
    keys = customers(spark, sf_dir)
    got = db.get_many(keys).select("id", F.col("_seq").alias("seq"))
    return db.has_many(keys).join(got, "id", "left")


@query
def block_pack(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return blocks.pack(docs, "doc_id", "n_chars", 50_000, "source")


@query
def utf16_units(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", utf16_length(F.col("text")).alias("utf16_units"), utf8_length(F.col("text")).alias("utf8_bytes"))


@query
def project_field(spark, sf_dir):
    rows = with_value(table(spark, sf_dir, "events").select("event_id", "props"), "props")
    rows = rows.select("event_id", project_fields(F.col("_value"), ["k", "absent"]).alias("fields"))
    return rows.select("event_id", F.element_at("fields", "k").alias("k"), F.size("fields").cast("long").alias("n_fields"))


def _odd_record() -> Column:
    """A line for each event, of which seven in eight have something wrong."""
    n, i = F.col("event_id"), F.col("event_id").cast("string")
    good = F.concat(F.lit('{"id":"'), i, F.lit('","_oid":1,"_rid":'), i, F.lit(',"_seq":'), i, F.lit("}"))
    cases = [
        good, F.concat(F.lit('{"_oid":1,"_rid":1,"_seq":'), i, F.lit("}")), F.concat(F.lit('{"id":'), i, F.lit(',"_oid":1,"_rid":1,"_seq":1}')),
        F.concat(F.lit('{"id":"'), i, F.lit('","_rid":1,"_seq":1}')), F.concat(F.lit('{"id":"'), i, F.lit('","_oid":"1","_rid":1,"_seq":1}')),
        F.concat(F.lit('{"id":"'), i, F.lit('","_oid":1,"_rid":true,"_seq":1}')), F.concat(F.lit('{"id":"'), i), F.concat(good, F.lit(" x")),
    ]
    out = cases[-1]
    for k, c in reversed(list(enumerate(cases[:-1]))):
        out = F.when(n % 8 == k, c).otherwise(out)
    return out


@query
def validate_records(spark, sf_dir):
    rows = with_error(table(spark, sf_dir, "events").select("event_id", _odd_record().alias("line")))
    return rows.select("event_id", F.coalesce("error", F.lit("ok")).alias("error"))


@query
def block_scan(spark, sf_dir):
    """Pages as files: what follows the last line's end is dropped."""
    return number_lines(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("bid"), F.regexp_replace("html", "\n+", "\n").alias("html")), "html", name="bid")


@query
def custom_break(spark, sf_dir):
    return number_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ". ")


@query
def line_scan(spark, sf_dir):
    return number_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def _users(spark, sf_dir, kind):
    return bitset.bitset(table(spark, sf_dir, "events").where(F.col("event_type") == kind), "user_id")


def _orders(spark, sf_dir, flag):
    return bitset.bitset(table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag), "l_orderkey")


@query
def bitset_union(spark, sf_dir):
    return bitset.union(_users(spark, sf_dir, "click"), _users(spark, sf_dir, "view"))


@query
def bitset_intersection(spark, sf_dir):
    return bitset.intersection(_users(spark, sf_dir, "click"), _users(spark, sf_dir, "view"))


@query
def bitset_difference(spark, sf_dir):
    return bitset.difference(_orders(spark, sf_dir, "R"), _orders(spark, sf_dir, "A"))


@query
def bitset_clear(spark, sf_dir):
    return bitset.clear_multiple(_orders(spark, sf_dir, "N"), _orders(spark, sf_dir, "R"))


@query
def bitset_set(spark, sf_dir):
    return bitset.set_multiple(_orders(spark, sf_dir, "A"), _orders(spark, sf_dir, "R"))


@query
def bitset_resize(spark, sf_dir):
    return bitset.capacity(_orders(spark, sf_dir, "A"), 100_000_000)


@query
def bitset_packed_union(spark, sf_dir):
    """Sizes of the union, through bitmaps."""
    both = bitset.packed_union(bitset.packed(_orders(spark, sf_dir, "A")), bitset.packed(_orders(spark, sf_dir, "R")))
    return both.agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


@query
def bitset_packed_intersection(spark, sf_dir):
    both = bitset.packed_intersection(bitset.packed(_orders(spark, sf_dir, "A")), bitset.packed(_orders(spark, sf_dir, "R")))
    return both.agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


@query
def bitset_probe(spark, sf_dir):
    return bitset.probe(_users(spark, sf_dir, "purchase"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bit")))


@query
def bitset_iterate(spark, sf_dir):
    return bitset.iterate(bitset.bitset(table(spark, sf_dir, "orders"), "o_custkey"))


@query
def bitset_capacity(spark, sf_dir):
    return bitset.capacity(bitset.bitset(table(spark, sf_dir, "orders"), "o_orderkey"))


def _lines_index(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return sorted_index.upsert(rows, ["l_orderkey", "l_linenumber"], ["l_partkey"], F.struct("l_shipdate", "l_partkey", "l_suppkey"))


@query
def index_upsert(spark, sf_dir):
    return _lines_index(spark, sf_dir)


@query
def index_seek(spark, sf_dir):
    return sorted_index.seek(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"], [5, 1])


@query
def index_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return sorted_index.delete(_lines_index(spark, sf_dir), ["l_orderkey", "l_linenumber"], gone)


@query
def index_scan(spark, sf_dir):
    return sorted_index.scan(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])


@query
def lower_bound(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    return sorted_index.lower_bound(keys, "o_custkey", table(spark, sf_dir, "customer"), "c_custkey", stride=2)


@query
def compound_lower_bound(spark, sf_dir):
    """Rows of three cells; probes are the lines' order keys with the numbers of the lines after them."""
    rows = table(spark, sf_dir, "lineitem")
    probes = rows.select("l_orderkey", (F.col("l_linenumber") + 1).cast("long").alias("line"))
    return sorted_index.lower_bound_compound(rows, ["l_orderkey", "l_linenumber"], probes, ["l_orderkey", "line"], stride=3)


def _cells(spark, sf_dir):
    """Each order's part keys, by line, as a list of cells."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("rows"))
    return rows.select("l_orderkey", F.transform("rows", lambda r: r["l_partkey"]).alias("cells"))


@query
def cell_get_set(spark, sf_dir):
    """A cell, one out of range, and the list's sum after a cell is set to -1 (4294967295)."""
    rows = _cells(spark, sf_dir)
    changed = cells.set_cell(F.col("cells"), F.size("cells") - 1, F.lit(-1))
    return rows.select("l_orderkey", cells.cell(F.col("cells"), F.lit(1)).alias("second"), cells.cell(F.col("cells"), F.lit(-1)).alias("before"), F.aggregate(changed, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query
def cell_push_pop(spark, sf_dir):
    rows = _cells(spark, sf_dir).withColumn("more", cells.push(F.col("cells"), F.lit(4294967297)))
    return rows.select("l_orderkey", cells.popped(F.col("more")).alias("last"), F.size("more").cast("long").alias("length"), F.size(cells.without_last(F.col("more"))).cast("long").alias("left"), cells.popped(cells.without_last(F.slice("cells", 1, 1))).alias("none"))


@query
def cell_growth(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return rows.select("doc_id", cells.grown(F.col("n_chars"), F.greatest(F.col("n_chars"), F.lit(1024))).alias("capacity"))


@query
def cell_rows(spark, sf_dir):
    """Cells two by two."""
    rows = _cells(spark, sf_dir).select("l_orderkey", F.posexplode(sorted_index.rows_of(F.col("cells"), 1, 1)).alias("row", "pair"))
    return rows.select("l_orderkey", F.col("row").cast("long").alias("row"), F.get("pair", F.lit(0)).alias("key"), F.get("pair", F.lit(1)).alias("value"))


@query
def cell_index_of(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("cells"))
    return rows.select("l_orderkey", cells.index_of(F.col("cells"), F.lit(3)).alias("place"))


@query
def split_fields(spark, sf_dir):
    """The fifth and the ninth of five fields."""
    row = F.concat_ws("\x1f", *(F.col(c).cast("string") for c in ("event_id", "user_id", "event_type", "value", "props")))
    return table(spark, sf_dir, "events").select("event_id", split_part(row, 5).alias("fifth"), split_part(row, 9).alias("ninth"))


@query
def compound_compare(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", sorted_index.compare([F.col("l_orderkey"), F.col("l_linenumber")], [F.lit(700), F.lit(3)]).alias("side"))


@query
def base36_id(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", base36(F.col("o_orderkey")).alias("base36"))


@query
def stream_latest(spark, sf_dir):
    """kv_live, followed as a stream."""
    from tidelog.streaming.changes import follow, state

    at = f"{shared_place(spark)}/stream-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "events")
    changes = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*").select(
        F.col("user_id").cast("string").alias("id"), F.when(F.col("event_type") == "error", DELETE).otherwise(SET).alias("_oid"), F.col("event_id").alias("_seq"), F.col("props").alias("record")
    )
    follow(changes, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return merge.live(state(spark, f"{at}/out")).select("id", F.col("_seq").alias("seq"), "record")
