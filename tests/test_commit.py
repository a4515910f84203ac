"""Commits, crashes, locks, maintenance, error rows and other storages."""

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from tidelog.functions import cells, timing
from tidelog.functions.text import split_part
from tidelog.model import Options
from tidelog.operators import blocks, sorted_index
from tidelog.operators.prefix import running_sums
from tidelog.plans.store import Store, open_store
from tidelog.sources import blocks as files
from tidelog.sources.storage import Conflict, DirectoryStorage


def url(path):
    return f"file://{path}"


def content(db):
    return {r["id"]: json.loads(r["record"]) for r in db.live.collect()}


STEPS = ["append", "commit", "rename", "unlock", "writer"]


class Crash(Exception):
    pass


class Crashing(DirectoryStorage):
    """Fails before or after the n-th step of a commit."""

    def __init__(self, spark, path, step, after):
        super().__init__(spark, path)
        self.step, self.after, self.armed = step, after, False

    def __getattribute__(self, name):
        found = super().__getattribute__(name)
        if name not in STEPS or not super().__getattribute__("armed") or name != super().__getattribute__("step"):
            return found

        def broken(*args, **kw):
            if super(Crashing, self).__getattribute__("after"):
                found(*args, **kw)
            raise Crash

        return broken


def filled(spark, at):
    db = open_store(spark, dir_path=at)
    first = db.apply([(n, f"k{n}", 1, json.dumps({"n": n})) for n in range(40)])
    db.apply([(n, f"k{n}", 2 if n % 4 else 1, '{"n":-1}') for n in range(20)])
    return db, first[0]


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("step", ["append", "commit", "rename"])
def test_crash_in_a_compaction(spark, tmp_path, step, after):
    at = url(tmp_path / "db")
    db, block = filled(spark, at)
    want = content(db)
    db.storage = Crashing(spark, at, step, after)
    db.storage.armed = True
    with pytest.raises(Crash):
        db.compact(block)
    again = open_store(spark, dir_path=at)
    assert content(again) == want and not again.has("k1")
    if block in again.storage.blocks():  # what had not held can be done again
        again.compact(block)
    assert content(again) == want and content(open_store(spark, dir_path=at)) == want


@pytest.mark.parametrize("step,after,there", [("append", False, False), ("append", True, False), ("commit", False, False), ("commit", True, True)])
def test_crash_in_a_batch(spark, tmp_path, step, after, there):
    """A batch of several files is there as a whole or not at all."""
    at = url(tmp_path / "db")
    db, _ = filled(spark, at)
    before = content(db)
    db.options.max_block_size = 300
    db.storage = Crashing(spark, at, step, after)
    db.storage.armed = True
    with pytest.raises(Crash):
        db.apply([(n, f"x{n}", 1, "{}") for n in range(30)])
    got = content(open_store(spark, dir_path=at))
    assert {k for k in got if k[0] == "x"} == ({f"x{n}" for n in range(30)} if there else set())
    assert {k: v for k, v in got.items() if k[0] == "k"} == before


def test_torn_manifest_and_conflict(spark, tmp_path):
    at = url(tmp_path / "db")
    db, _ = filled(spark, at)
    want = content(db)
    version = db.storage._manifest()[0]
    (tmp_path / "db" / f"manifest-{version + 1:020d}.json").write_text('{"blocks": [')
    again = open_store(spark, dir_path=at)
    assert content(again) == want
    again.apply([(1, "new", 1, "{}")])
    assert content(open_store(spark, dir_path=at)).keys() == want.keys() | {"new"}
    late, held = DirectoryStorage(spark, at), again.storage._manifest()
    late._manifest = lambda: (held[0] - 1, held[1])  # read before the other's commit
    with pytest.raises(Conflict):
        late.commit(["b.block"])


def test_locks(spark, tmp_path):
    db, block = filled(spark, url(tmp_path / "db"))
    assert db.storage.lock(block)
    with pytest.raises(RuntimeError, match="Block is already locked"):
        db.compact(block)
    db.unlock(block)
    db.compact(block)
    assert not any(n.endswith(".lock") for n in (p.name for p in (tmp_path / "db").iterdir()))


def test_maintenance(spark, tmp_path):
    at = url(tmp_path / "db")
    db = open_store(spark, dir_path=at, stale_data_threshold=0.3, compact_delay=60_000)
    block = db.apply([(n, f"k{n}", 1, '{"v":"xxxxxxxxxx"}') for n in range(20)])[0]
    db.apply([(n, f"k{n}", 1, "{}") for n in range(15)])
    want = content(db)
    assert db.maintain(1000.0) == [block] and db.maintain(1030.0) == [] and db.maintain(1061.0) == []
    assert content(db) == want and block not in db.storage.blocks()
    assert db.blocks().where("stale_bytes > 0.3 * size").count() == 0


def test_error_rows(spark, tmp_path):
    (tmp_path / "db").mkdir()
    good = '{"id":"a","_oid":1,"_rid":1,"_seq":1}\n'
    (tmp_path / "db" / "a.block").write_text(good + "{x\n" + '{"id":"b","_oid":1,"_rid":2}\n', newline="")
    said = []
    db = open_store(spark, dir_path=url(tmp_path / "db"), on_error=said.append)
    assert said == ["Invalid JSON entry in a.block at lineNo:2: not one JSON value", "Invalid JSON entry in a.block at lineNo:3: _seq is missing"]
    assert db.has("a") and not db.has("b") and [r["line_no"] for r in db.errors.orderBy("line_no").collect()] == [2, 3]
    with pytest.raises(TypeError):
        Options.of({"dir_path": "x", "on_error": 3})


def test_single_calls_do_not_reread(spark, tmp_path, monkeypatch):
    at = url(tmp_path / "db")
    db, _ = filled(spark, at)
    loads = []
    held = DirectoryStorage.load
    monkeypatch.setattr(DirectoryStorage, "load", lambda *a, **k: loads.append(a) or held(*a, **k))
    began = time.perf_counter()
    for n in range(300):
        db.set(f"s{n % 50}", {"n": n})
        db.delete(f"s{n % 7}")
    assert db.get("s49") == {"n": 299, "id": "s49", "_seq": db.get("s49")["_seq"], "_rid": db.get("s49")["_rid"], "_oid": 1}
    assert not loads and time.perf_counter() - began < 20
    db.apply([(1, "s49", 1, "{}"), (2, "k1", 1, "{}")])  # reads its own blocks alone
    assert len(loads) == 1
    want, seq, rid = content(db), db.seq, db.rid
    again = open_store(spark, dir_path=at)
    assert content(again) == want and (again.seq, again.rid) == (seq, rid)
    assert db.get_many(spark.createDataFrame([("s49",), ("s3",)], "id string")).count() == len({"s49", "s3"} & want.keys())


def test_layers_and_larger_stores(spark, tmp_path, monkeypatch):
    """Views over one another, and keys looked up by queries."""
    import tidelog.plans.store as module

    monkeypatch.setattr(module, "LAYERS", 3)
    monkeypatch.setattr(module, "HELD_KEYS", 5)
    monkeypatch.setattr(module, "CHANGES", 4)
    at = url(tmp_path / "db")
    db = open_store(spark, dir_path=at, max_block_size=1024)
    want = {}
    for n in range(6):
        db.apply([(k, f"k{k}", 1, json.dumps({"n": n})) for k in range(n, n + 8)])
        want |= {f"k{k}": n for k in range(n, n + 8)}
    for n in range(9):
        db.set(f"k{n}", {"n": 100 + n})
        want[f"k{n}"] = 100 + n
    db.delete("k0")
    del want["k0"]
    assert {k: v["n"] for k, v in content(db).items()} == want and db.get("k3")["n"] == 103 and db.get("k0") is None
    assert {k: v["n"] for k, v in content(open_store(spark, dir_path=at)).items()} == want


class Memory:
    """A storage of lists on the driver."""

    def __init__(self, spark):
        self.spark, self.held, self.counted, self.locks = spark, {}, [], set()

    def ensure(self):
        pass

    def blocks(self):
        return sorted(n for n in self.counted if n in self.held)

    def stats(self):
        return self.spark.createDataFrame([(n, sum(len(x.encode()) + 1 for x in self.held[n])) for n in self.blocks()], "bid string, size long")

    def load(self, names, strict=True):
        rows = [(n, i + 1, x) for n in names for i, x in enumerate(self.held[n])]
        return files.parse_lines(self.spark.createDataFrame(rows, "bid string, line_no long, line string"), strict)

    def append(self, records, first, n, tag=""):
        name = files.block_name(first, f"{tag}m")
        self.held[name] = [r["record"] for r in records.orderBy("_seq").collect()]
        return [name] if self.held[name] else []

    def writer(self, first):
        lines = self.held.setdefault(files.block_name(first, "s"), [])

        class Writer:
            name, size = files.block_name(first, "s"), 0

            def write(self, line):
                lines.append(line)

            def close(self):
                pass

        return Writer()

    def commit(self, add, retire=()):
        self.counted = [n for n in {*self.counted, *add} if n not in retire]

    def rename(self, old, new):
        self.held[new] = self.held.pop(old)

    def delete(self, bid):
        del self.held[bid]

    def lock(self, bid):
        taken = bid in self.locks
        self.locks.add(bid)
        return not taken

    def unlock(self, bid):
        self.locks.discard(bid)


def test_another_storage(spark):
    place = Memory(spark)
    db = Store(spark, place, dir_path="-")
    block = db.apply([(n, f"k{n}", 1, json.dumps({"n": n})) for n in range(10)])[0]
    db.set("k1", {"n": -1})
    db.delete("k2")
    want = content(db)
    db.compact(block)
    assert content(db) == want and len(want) == 9 and content(Store(spark, place, dir_path="-")) == want


def test_running_sums_in_groups(spark):
    rows = [(g, x * x * 977 - 50_000, x) for g in range(3) for x in range(400)]
    df = spark.createDataFrame(rows, "g int, at long, v long")
    got = {(r["g"], r["at"]): r["s"] for r in running_sums(df, "at", {"s": F.col("v")}, ["g"]).collect()}
    want = {}
    for g, at, v in sorted(rows):
        want[g, at] = want.get((g, last), 0) + v if want and last_g == g else v  # noqa: F821
        last_g, last = g, at  # noqa: F841
    assert got == want
    wide = spark.createDataFrame([(-(2**62),), (5,), (2**62,), (2**40,)], "at long")
    assert sorted(tuple(r) for r in running_sums(wide, "at", {"n": F.lit(1)}).collect()) == [(-(2**62), 1), (5, 2), (2**40, 3), (2**62, 4)]


def test_compound_lower_bound(spark):
    index = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (3, 6)], "a long, b long")
    probes = [(0, 9), (1, 2), (1, 3), (2, 1), (3, 4), (3, 5), (3, 7), (9, 0)]
    got = sorted_index.lower_bound_compound(index, ["a", "b"], spark.createDataFrame(probes, "x long, y long"), ["x", "y"], stride=4)
    held = [(1, 2), (2, 3), (3, 4), (3, 6)]
    assert sorted(map(tuple, got.collect())) == [(*p, 4 * sum(k < p for k in held), p in held) for p in probes]
    with pytest.raises(ValueError, match="Invalid key length"):
        sorted_index.lower_bound_compound(index, ["a", "b"], index, ["a"])


def test_compound_lower_bound_by_ranges(spark, monkeypatch, tmp_path):
    """Ranges follow the number of keys and probes, not the session's partitions; keys and probes that
    come again count once, also across batches."""
    import random

    rng = random.Random(3)
    keys = [(rng.choice([None, *range(-4, 5)]), rng.choice([None, *range(-40, 40)])) for _ in range(3000)]
    probes = [(rng.choice([None, *range(-6, 7)]), rng.randrange(-50, 50)) for _ in range(2000)]
    monkeypatch.setattr(sorted_index, "SORTED_ROWS", 100)
    monkeypatch.setattr(sorted_index, "shared_place", lambda spark: f"file://{tmp_path}")
    held = sorted({*keys}, key=lambda k: [(x is not None, x or 0) for x in k])
    below = {p: sum([(x is not None, x or 0) for x in k] < [(True, x) for x in p] for k in held) for p in probes if p[0] is not None}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(keys, "a int, b long")
        got = sorted_index.lower_bound_compound(df, ["a", "b"], spark.createDataFrame(probes, "x long, y int"), ["x", "y"], stride=3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got)) == sorted((*p, 3 * n, p in held) for p, n in below.items())
    made = spark.read.parquet(f"file://{tmp_path}/bounds-*")
    assert made.select("_range").distinct().count() > 25


def test_small_blocks_share_tasks(spark, tmp_path, monkeypatch):
    """Many small blocks are written by few tasks and read by few, from one listing; blocks that don't
    count, and those of other batches, are left out."""
    at = url(tmp_path / "db")
    db = open_store(spark, dir_path=at, max_block_size=1024)
    ops = [(n, f"k{n % 4000}", 2 if n % 7 == 3 else 1, json.dumps({"n": n, "é": "x" * (n % 50)})) for n in range(6000)]
    started = []
    held = DirectoryStorage.append

    def append(*a, **k):
        out = held(*a, **k)
        started.append(spark.sparkContext.statusTracker().getJobIdsForGroup("append"))
        return out

    monkeypatch.setattr(DirectoryStorage, "append", append)
    spark.sparkContext.setJobGroup("append", "append")
    try:
        names = db.apply(spark.createDataFrame(ops, "ord long, id string, op int, record string"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(names) > 300 and names == sorted(names) == db.storage.blocks()
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for job in started[0] for s in tracker.getJobInfo(job).stageIds]
    assert max(s.numTasks for s in stages if s) < 100
    seqs = [[r["_seq"] for r in files.load(spark, at, [n]).orderBy("line_no").collect()] for n in names[::40]]
    assert all(s == list(range(s[0], s[0] + len(s))) for s in seqs) and all(a[-1] < b[0] for a, b in zip(seqs, seqs[1:]))
    (tmp_path / "db" / f"{names[5]}x.block").write_text("not a record\n")  # between the batch's blocks, never committed
    sizes = {p.name: p.stat().st_size for p in (tmp_path / "db").iterdir() if p.name in names}
    assert {r["bid"]: r["size"] for r in db.blocks().collect()} == sizes and max(sizes.values()) < 2048
    some = files.load(spark, at, names[:200])
    assert some.select("bid").distinct().count() == 200 and some.rdd.getNumPartitions() <= 8
    want = content(db)
    db.apply([(n, f"m{n}", 1, "{}") for n in range(500)])
    again = open_store(spark, dir_path=at, max_block_size=1024)
    got = content(again)
    assert {k: v for k, v in got.items() if k[0] == "k"} == want and len(got) == len(want) + 500
    assert (again.seq, again.rid) == (db.seq, db.rid)


def test_listing_of_other_forms(spark, tmp_path, monkeypatch):
    """What a file system prints is only used where it can be read."""
    for n, size in (("b.block", 3), ("a; isDirectory=true; x.block", 5), ("c d%20.txt", 0)):
        (tmp_path / n).write_text("x" * size)
    (tmp_path / "dir.block").mkdir()
    at = url(tmp_path)
    want = [("a; isDirectory=true; x.block", 5), ("b.block", 3), ("c d%20.txt", 0)]
    assert sorted(files.listed(spark, at)) == want
    monkeypatch.setattr(files, "STATUS", re.compile("-"))
    assert sorted(files.listed(spark, at)) == want and files.listed(spark, f"{at}/dir.block") == []


def test_opening_counts_buried_lines(spark, tmp_path):
    """The highest numbers are those of all lines, whichever counts."""
    (tmp_path / "db").mkdir()
    line = '{{"id":"x","_oid":1,"_rid":{},"_seq":{}}}\n'
    (tmp_path / "db" / "a.block").write_text(line.format(7, 90) + line.format(3, 4), newline="")
    db = open_store(spark, dir_path=url(tmp_path / "db"))
    assert (db.seq, db.rid) == (90, 7) and db.get("x")["_seq"] == 4


def test_many_blocks_compacted_together(spark, tmp_path, monkeypatch):
    """More blocks than a filter names: tombstones stay only for keys with lines in other blocks, only
    those are read for it, and the locks are gone."""
    at = url(tmp_path / "db")
    db = open_store(spark, dir_path=at, max_block_size=1024, stale_data_threshold=0.5)
    kept = db.apply([(n, f"k{n}", 1, json.dumps({"n": n})) for n in range(15)])
    pad = "x" * 40
    db.apply([(n, f"m{n % 50}", 1, json.dumps({"n": n, "pad": pad})) for n in range(900)])
    db.apply([(n, f"{'k' if n < 3 else 'm'}{n}", 2, "{}") for n in range(6)])
    want, read, held = content(db), [], DirectoryStorage.load
    monkeypatch.setattr(DirectoryStorage, "load", lambda self, names, strict=True: read.append(names) or held(self, names, strict))
    done = db.maintain(1e9)
    assert len(done) > blocks.NAMED and not set(done) & set(read[0])
    assert not [p.name for p in (tmp_path / "db").iterdir() if p.name.endswith(".lock")]
    assert content(db) == want and len(want) == 15 - 3 + 50 - 3
    again = open_store(spark, dir_path=at)
    assert content(again) == want and not again.has("k1") and not again.has("m4")
    assert not set(done) & set(again.storage.blocks()) and set(kept) <= set(again.storage.blocks()) | set(done)


def test_cells(spark):
    c = F.col("c")
    df = spark.createDataFrame([([5, 6, 7],), ([],)], "c array<long>")
    got = df.select(cells.cell(c, F.lit(1)), cells.cell(c, F.lit(3)), cells.cell(c, F.lit(-1)), cells.push(c, F.lit(-1)), cells.popped(c), cells.without_last(c), cells.index_of(c, F.lit(7)), sorted_index.rows_of(c, 1, 1)).collect()
    assert tuple(got[0]) == (6, None, None, [5, 6, 7, 4294967295], 7, [5, 6], 2, [[5, 6], [7]])
    assert tuple(got[1]) == (None, None, None, [4294967295], None, [], -1, [])
    assert df.limit(1).select(cells.set_cell(c, F.lit(0), F.lit(9))).first()[0] == [9, 6, 7]
    for place in (3, -1):
        with pytest.raises(Exception, match="Index out of bounds"):
            df.limit(1).select(cells.set_cell(c, F.lit(place), F.lit(9))).collect()
    with pytest.raises(Exception, match="Array size exceeds the maximum limit"):
        df.select(cells.grown(F.lit(2**31), F.lit(2**31))).collect()
    assert [r[0] for r in spark.range(1).select(F.explode(F.array(cells.grown(F.lit(10), F.lit(1024)), cells.grown(F.lit(1000), F.lit(1024)), cells.grown(F.lit(4096), F.lit(4096))))).collect()] == [1024, 4096, 8192]
    assert spark.range(1).select(split_part(F.lit("a\x1fb"), 2), split_part(F.lit("a\x1fb"), 5)).first() == ("b", "")


def test_timing():
    ids = [timing.unique_id() for _ in range(100)]
    assert len({*ids}) == 100 and ids == sorted(ids) and abs(int(ids[0], 36) / 1000 - time.time()) < 1000
    said = []
    late, now = timing.debounce(said.append, 60), timing.throttle(said.append, 60_000)
    for n in range(3):
        late(n)
    assert said == []
    time.sleep(0.3)
    assert said == [2]
    for n in (7, 8):
        now(n)
    assert said == [2, 7]


def test_free_block(spark):
    rows = [(0, "a", 150, False), (1, "b", 50, True), (2, "c", 50, False), (3, "d", 50, False)]
    df = spark.createDataFrame(rows, "index long, bid string, size long, locked boolean")

    def got(last, most=100):
        return tuple(blocks.free_block(df, last, most).first())

    assert [got(i) for i in (0, 1, 2, 3, 4, -1)] == [(2, "c"), (2, "c"), (2, "c"), (3, "d"), (2, "c"), (2, "c")]
    assert got(0, 50) == (None, None) and got(1, 200) == (2, "c") and got(7, 200) == (0, "a")
    assert tuple(blocks.free_block(df.where("index < 2"), 1, 100).first()) == (None, None)


def test_pack_against_a_loop(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2]), n, rng.choice([None, 0, 5, 60, 300])) for n in range(500)]
    got = blocks.pack(spark.createDataFrame(rows, "g int, n int, size int"), "n", "size", 100, "g").collect()
    want = {}
    for g in (None, 1, 2):
        block = held = 0
        for _, n, size in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            block, held = (block + 1, 0) if held >= 100 else (block, held)
            held += size or 0
            want[n] = block
    assert {r["n"]: r["block"] for r in got} == want
