"""The store facade, block files and options: the behaviour of single calls and reloads."""

import datetime
import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidelog.functions.text import encode, project_fields, utf16_length, with_error, with_value
from tidelog.model import Options
from tidelog.operators import bitset, blocks, merge, oplog, sorted_index
from tidelog.plans.store import open_store
from tidelog.sources import blocks as files


def write(path, name, text):
    (path / name).write_text(text, newline="")


def url(path):
    return f"file://{path}"


def line(i, seq, rid=1, oid=1, **more):
    return json.dumps({"id": i, "_oid": oid, "_rid": rid, "_seq": seq, **more}, ensure_ascii=False) + "\n"


def test_options():
    with pytest.raises(ValueError, match="dirPath is required"):
        Options.of({})
    with pytest.raises(ValueError, match="maxBlockSize"):
        Options.of({"dir_path": "x", "max_block_size": 1000})
    with pytest.raises(ValueError, match="staleDataThreshold"):
        Options.of({"dir_path": "x", "stale_data_threshold": 1.5})
    o = Options.of({"dir_path": "x", "max_block_size": 0, "data_sync_delay": -1, "stale_data_threshold": 0, "compact_delay": 0, "cached_fields": []})
    assert (o.max_block_size, o.data_sync_delay, o.stale_data_threshold, o.cached_fields) == (8 << 20, -1, 0.1, [])


def test_set_get_delete_and_reload(spark, tmp_path):
    at = url(tmp_path / "db")
    db = open_store(spark, dir_path=at)
    mine = {"name": "John Doe", "_seq": 99, "nested": {"a": [1, None, "é😀"]}}
    got = db.set("1", mine)
    assert got == {"name": "John Doe", "_seq": 1, "nested": {"a": [1, None, "é😀"]}, "id": "1", "_rid": 1, "_oid": 1}
    assert list(got) == ["name", "_seq", "nested", "id", "_rid", "_oid"] and mine["_seq"] == 99
    assert db.set("1", {"name": "Jane"})["_seq"] == 2 and db.has("1") and not db.has("2") and db.get("2") is None
    db.delete("2")
    assert db.seq == 2
    db.delete("1")
    assert db.get("1") is None and not db.has("1") and db.seq == 3
    assert db.set("1", {"name": "again"})["_rid"] == 2
    db.close()
    with pytest.raises(RuntimeError, match="Db should be opened before operation"):
        db.get("1")
    with pytest.raises(RuntimeError):
        db.close()
    again = open_store(spark, dir_path=at, cached_fields=["name", "none"])
    assert again.get("1")["name"] == "again" and (again.seq, again.rid) == (4, 2)
    assert again.live.select("cache").first()["cache"] == {"name": '"again"'}
    for bad in ("", None):
        with pytest.raises(ValueError, match="id is required"):
            again.has(bad)
    with pytest.raises(TypeError):
        again.set(5, {})
    again.close()


def test_reload_rule_keeps_the_rid(spark, tmp_path):
    db = open_store(spark, dir_path=url(tmp_path / "db"), reload_rule=True)
    db.apply([(1, "a", 1, "{}"), (2, "a", 2, None), (3, "b", 1, "{}")])
    assert db.set("a", {})["_rid"] == 1
    db.close()


def simulate(ops):
    live, seq, rid, out = {}, 0, 0, []
    for ord_, i, op in ops:
        if op == 1:
            if i not in live:
                rid += 1
                live[i] = rid
            seq += 1
            out.append((ord_, i, op, seq, live[i]))
        elif i in live:
            seq += 1
            out.append((ord_, i, op, seq, live.pop(i)))
    return out, live


def test_stamping_against_a_simulation(spark):
    rng = random.Random(4)
    ops = [(n, f"k{rng.randrange(40)}", 1 if rng.random() < 0.6 else 2) for n in range(3000)]
    df = spark.createDataFrame(ops, "ord long, id string, op int").repartition(5)
    want, live = simulate(ops)
    got = oplog.stamp(df).select("ord", "id", "op", "_seq", "_rid").collect()
    assert sorted(map(tuple, got)) == want
    first, second = ops[:1000], ops[1000:]
    done, held = simulate(first)
    base = (max(r[3] for r in done), max(r[4] for r in done))
    known = spark.createDataFrame(list(held.items()), "id string, _rid long")
    rest = oplog.stamp(spark.createDataFrame(second, "ord long, id string, op int"), known, *base).select("ord", "id", "op", "_seq", "_rid").collect()
    assert sorted(map(tuple, rest)) == want[len(done) :]
    assert oplog.stamp(df.where("false")).count() == 0


def test_volume_and_compaction(spark, tmp_path):
    at = url(tmp_path / "db")
    db = open_store(spark, dir_path=at, max_block_size=64 * 1024)
    db.apply([(n, str(n), 1, json.dumps({"word": "日本語" * (n % 9), "n": n})) for n in range(5000)])
    names = files.list_files(spark, at)
    assert len(names) > 3
    db.apply([(n, str(n), 1 if n % 2 else 2, "{}") for n in range(2500)])
    keys = spark.createDataFrame([(str(n),) for n in range(-5, 5005)], "id string")
    assert db.has_many(keys).agg(F.sum("present")).first()[0] == 3750 and db.get_many(keys).count() == 3750
    sizes = {r["bid"]: r for r in db.blocks().collect()}
    assert sizes[names[0]]["stale_bytes"] == sizes[names[0]]["size"] and sizes[names[-1]]["stale_bytes"] == 0
    assert names[0] in {r["bid"] for r in db.candidates().collect()}
    before = {r["id"]: r["record"] for r in db.live.collect()}
    for name in [names[0], files.list_files(spark, at)[-1]]:
        db.compact(name)
    with pytest.raises(KeyError, match="Block not found"):
        db.compact("none.block")
    db.close()
    again = open_store(spark, dir_path=at)
    assert {r["id"]: r["record"] for r in again.live.collect()} == before and not again.has("0")
    assert names[0] not in files.list_files(spark, at)
    again.close()


def test_two_level_merge(spark, tmp_path):
    (tmp_path / "db").mkdir()
    write(tmp_path / "db", "a.block", line("x", 9, v="old line") + line("x", 1, v="last line") + line("y", 4, v="a"))
    write(tmp_path / "db", "b.block", line("y", 4, v="later block") + line("z", 2, oid=2) + line("w", 3, oid=99))
    write(tmp_path / "db", "c.block", line("x", 0, v="lower") + line("z", 1, v="buried") + line("torn", 8)[:-1])
    write(tmp_path / "db", "d.txt", "ignored")
    db = open_store(spark, dir_path=url(tmp_path / "db"))
    assert db.get("x")["v"] == "last line" and db.get("y")["v"] == "later block"
    assert not db.has("z") and db.has("w") and not db.has("torn") and db.seq == 9
    assert merge.rid_conflicts(db.current.where("id in ('x', 'y')")).count() == 1
    db.close()


@pytest.mark.parametrize("bad,message", [("\n", "Empty line in file"), ("{x\n", "Invalid JSON entry in a.block at lineNo:2"), ('{"id":"1","_oid":1,"_rid":1}\n', "_seq is missing"), ('{"id":1,"_oid":1,"_rid":1,"_seq":1}\n', "id must be a string"), (line("b", 2)[:-1] + " x\n", "not one JSON value"), (line("b", 2)[:-1] * 2 + "\n", "not one JSON value")])
def test_bad_lines_fail_the_opening(spark, tmp_path, bad, message):
    (tmp_path / "db").mkdir()
    write(tmp_path / "db", "a.block", line("a", 1) + bad)
    with pytest.raises(PySparkException, match=message):
        open_store(spark, dir_path=url(tmp_path / "db"))


def test_line_scan(spark, tmp_path):
    write(tmp_path, "f.txt", "1234567890\n12 3\\n4\r\n5")
    rows = files.read_lines(spark, url(tmp_path), extension=".txt").collect()
    assert [(r["line_no"], r["line"]) for r in rows] == [(1, "1234567890"), (2, "12 3\\n4\r")]
    write(tmp_path, "g.log", "a||b|c||")
    assert [r["line"] for r in files.read_lines(spark, url(tmp_path), "||", ".log").collect()] == ["a", "b|c"]
    assert files.read_lines(spark, url(tmp_path), extension=".none").count() == 0
    with pytest.raises(NotADirectoryError):
        files.ensure_dir(spark, url(tmp_path / "f.txt"))
    with pytest.raises(IsADirectoryError):
        files.ensure_file(spark, url(tmp_path))
    files.ensure_file(spark, url(tmp_path / "new.block"))
    files.rename_block(spark, url(tmp_path), "new.block", "old.block")
    files.delete_block(spark, url(tmp_path), "old.block")
    assert files.list_files(spark, url(tmp_path)) == []


def test_functions(spark):
    rows = spark.createDataFrame([("NaN",), ('{"a":null,"b":{"c":1}}',), (None,)], "line string")
    assert [r["error"] for r in with_error(rows).collect()] == ["not one JSON value", "id is missing", "not one JSON value"]
    row = with_value(rows.where("line like '%null%'")).select(utf16_length(F.lit("a😀é")).alias("n"), project_fields(F.col("_value"), ["a", "b", "c"]).alias("p"), project_fields(F.col("_value"), []).alias("none")).first()
    assert row["n"] == 4 and row["p"] == {"a": "null", "b": '{"c":1}'} and row["none"] == {}
    at = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    assert encode({"x": float("nan"), "d": at, "f": print, "l": [print, 2.0], "s": {1}}) == '{"x":null,"d":"2024-05-06T07:08:09.123Z","l":[null,2],"s":{}}'


def bits(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "bit long")


def test_bitset(spark):
    a, b = bits(spark, 10, 8202, 40000), bits(spark, 20, 8202)

    def got(df):
        return sorted(r["bit"] for r in df.collect())

    assert got(bitset.union(a, b)) == [10, 20, 8202, 40000] and got(bitset.intersection(a, b)) == [8202] and got(bitset.difference(a, b)) == [10, 40000]
    assert got(bitset.clear_all(a)) == [] and bitset.capacity(a).first()[0] == 3 * 8192 and bitset.capacity(bits(spark), 8193).first()[0] == 2 * 8192
    assert [tuple(r) for r in bitset.probe(a, bits(spark, 10, 11, 10)).orderBy("bit").collect()] == [(10, 1), (10, 1), (11, 0)]
    assert [tuple(r) for r in bitset.iterate(a).orderBy("position").collect()] == [(10, 0), (8202, 1), (40000, 2)]
    n = F.sum(F.bitmap_count("bitmap"))
    assert bitset.packed_union(bitset.packed(a), bitset.packed(b)).agg(n).first()[0] == 4 and bitset.packed_intersection(bitset.packed(a), bitset.packed(b)).agg(n).first()[0] == 1


def test_sorted_index(spark):
    rows = spark.createDataFrame([(1, 2, 3, 4, 0), (2, 3, 5, 6, 1), (1, 2, 9, 9, 2)], "k0 long, k1 long, v0 long, v1 long, at int")
    index = sorted_index.upsert(rows, ["k0", "k1"], ["v0", "v1"], F.col("at"))
    assert [tuple(r) for r in sorted_index.scan(index, ["k0", "k1"]).collect()] == [(1, 2, 9, 9), (2, 3, 5, 6)]
    assert sorted_index.seek(index, ["k0", "k1"], [2, 3, 7]).first()["v0"] == 5
    assert sorted_index.delete(index, ["k0", "k1"], rows.where("k0 = 2")).count() == 1
    with pytest.raises(ValueError, match="Invalid key length"):
        sorted_index.seek(index, ["k0", "k1"], [2])
    with pytest.raises(ValueError, match="Invalid record length"):
        sorted_index.check_record([1, 2, 3], 2, 2)
    side = spark.range(1).select(*(sorted_index.compare([F.lit(a), F.lit(b)], [F.lit(3), F.lit(4)]).alias(f"c{i}") for i, (a, b) in enumerate([(3, 4), (2, 9), (3, 5)]))).first()
    assert tuple(side) == (0, -1, 1)
    assert spark.range(1).select(sorted_index.uint32(F.lit(-1))).first()[0] == 4294967295
    probes = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 4)], "p long")
    found = sorted_index.lower_bound(spark.createDataFrame([(1,), (3,)], "k long"), "k", probes, "p", stride=3).orderBy("p").collect()
    assert [tuple(r) for r in found] == [(0, 0, False), (1, 0, True), (2, 3, False), (3, 3, True), (4, 6, False)]


def test_pack_is_greedy(spark):
    rows = spark.createDataFrame([(n, 99) for n in range(7)], "n int, size int")
    assert [r["block"] for r in blocks.pack(rows, "n", "size", 100).orderBy("n").collect()] == [0, 0, 1, 1, 2, 2, 3]


def test_empty_stats(spark):
    none = spark.createDataFrame([], "_seq long, _rid long")
    assert tuple(blocks.sequence_stats(none).first()) == (0, 2**53 - 1, 0, 2**53 - 1)
