"""A sorted index over compound integer keys: unique keys, fixed numbers of keys and values."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.merge import best
from tidelog.operators.prefix import running_sums
from tidelog.sources.storage import shared_place

#: Keys and probes that one task of lower_bound_compound sorts, about; 50 bytes each.
SORTED_ROWS = 1 << 22


def uint32(n: Column) -> Column:
    """A cell's value: the number modulo 2^32."""
    return F.pmod(n.cast("long"), F.lit(4294967296))


def check_record(record: list, keys: int, values: int) -> None:
    if len(record) != keys + values:
        raise ValueError("Invalid record length")


def upsert(rows: DataFrame, keys: list[str], values: list[str], ordinal: Column) -> DataFrame:
    """One row for each key: the one that arrived last by `ordinal`."""
    slim = rows.select(*keys, *values, ordinal.alias("_ordinal"))  # what a struct holds can't be pruned later
    return best(slim, keys, F.col("_ordinal")).select(*keys, *values)


def seek(index: DataFrame, keys: list[str], key: list[int]) -> DataFrame:
    """The row of a key.  A longer key's further elements are ignored."""
    if len(key) < len(keys):
        raise ValueError("Invalid key length")
    out = index
    for c, v in zip(keys, key[: len(keys)], strict=True):
        out = out.where(F.col(c) == v)
    return out


def delete(index: DataFrame, keys: list[str], gone: DataFrame) -> DataFrame:
    return index.join(gone.select(*keys), keys, "left_anti")


def scan(index: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in key order."""
    return index.orderBy(*keys)


def compare(left: list[Column], right: list[Column]) -> Column:
    """-1, 0 or 1: the lexicographic order of two keys of the same number of parts."""
    if len(left) > len(right):
        raise ValueError("Invalid key length")
    a, b = (F.struct(*(c.cast("long").alias(f"k{i}") for i, c in enumerate(side[: len(left)]))) for side in (left, right))
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def lower_bound(index: DataFrame, key: str, probes: DataFrame, probe: str, stride: int = 1) -> DataFrame:
    """Each probe's cell offset (rows below it, times the stride) and whether it is there.

    Keys and probes are ordered together and keys are counted on the way, so neither side
    is compared with all of the other.  Keys are unique."""
    wanted = probes.select(F.col(probe).cast("long").alias("x")).distinct()
    held = index.select(F.col(key).cast("long").alias("x"), F.lit(1).alias("_key"))
    points = held.unionByName(wanted.withColumn("_key", F.lit(0))).groupBy("x").agg(F.max("_key").alias("_key"), F.min("_key").alias("_probe"), F.count("*").alias("_n"))
    counted = running_sums(points, "x", {"_below": F.col("_key")})
    asked = counted.where("_probe = 0")
    return asked.select(F.col("x").alias(probe), ((F.col("_below") - F.col("_key")) * stride).cast("long").alias("offset"), (F.col("_key") == 1).alias("found"))


def lower_bound_compound(index: DataFrame, keys: list[str], probes: DataFrame, wanted: list[str], stride: int | None = None) -> DataFrame:
    """lower_bound for keys of several parts, in lexicographic order; `stride` is the number of
    a row's cells, the keys' unless given.  A key or probe that comes again counts once; a key with
    nulls lies below those without, and a probe with nulls has no row.

    Keys and probes are dealt together by ranges, as many as their number asks for whatever the
    session's settings, and each range is counted in one pass in order.  The ranges' rows lie below the
    shared folder, as dealing them again would cut them elsewhere; only the ranges' totals are summed."""
    if len(wanted) < len(keys):
        raise ValueError("Invalid key length")
    spark, parts = index.sparkSession, [f"k{i}" for i in range(len(keys))]
    held = index.select(*(F.col(c).cast("long").alias(k) for c, k in zip(keys, parts, strict=True)), F.lit(1).cast("tinyint").alias("_key"))
    asked = probes.select(*(F.col(c).cast("long").alias(k) for c, k in zip(wanted, parts, strict=False)), F.lit(0).cast("tinyint").alias("_key")).dropna()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((index.count() + probes.count()) / SORTED_ROWS))
    order = [*parts, F.col("_key").desc()]  # a point's keys come before its probes
    at = f"{shared_place(spark)}/bounds-{uuid.uuid4().hex}"
    schema = ", ".join(f"{k} long" for k in parts) + ", _range int, _below long, found boolean"
    held.unionByName(asked).repartitionByRange(n, *parts).sortWithinPartitions(*order).mapInArrow(_bounds, schema).write.parquet(at)
    rows = spark.read.schema(schema).parquet(at)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.where("found is null").select("_range", F.coalesce(F.sum("_below").over(before), F.lit(0)).alias("_before"))  # n rows
    out = rows.where("found is not null").join(F.broadcast(totals), "_range")
    return out.select(*(F.col(k).alias(c) for c, k in zip(wanted, parts, strict=False)), ((F.col("_below") + F.col("_before")) * (stride or len(keys))).cast("long").alias("offset"), "found")


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range's keys (_key 1) and probes (0) in order, each probe with the range's keys below it
    and whether it is one; at the end, with `found` null, the number of the range's keys."""
    place, below, last, there = TaskContext.get().partitionId(), 0, None, 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        *parts, key = b.columns
        sides = [x for c in parts for x in (pc.fill_null(c, 0).to_numpy(), c.is_null().to_numpy(zero_copy_only=False))]
        key = key.to_numpy()
        point = np.zeros(n, bool)  # is it another point than the row before?
        for x in sides:
            point[1:] |= x[1:] != x[:-1]
        point[0] = last is None or last[:-1] != [x[0] for x in sides]
        fresh = point.copy()
        fresh[1:] |= key[1:] != key[:-1]
        fresh[0] |= last is not None and last[-1] != key[0]
        upto = below + np.cumsum(point & (key == 1))
        start = np.maximum.accumulate(np.where(point, np.arange(n), -1))
        own = np.where(start >= 0, key[start], there)
        below, last, there = int(upto[-1]), [*(x[-1] for x in sides), key[-1]], own[-1]
        out = np.flatnonzero(fresh & (key == 0))
        if len(out):
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(out)) for c in parts), pa.array(np.full(len(out), place, np.int32)), pa.array((upto - own)[out]), pa.array(own[out] == 1)], names=[*b.schema.names[:-1], "_range", "_below", "found"])
    if last is not None:
        none = [pa.nulls(1, pa.int64()) for _ in range((len(last) - 1) // 2)]
        yield pa.RecordBatch.from_arrays([*none, pa.array([place], pa.int32()), pa.array([below], pa.int64()), pa.array([None], pa.bool_())], names=[*(f"k{i}" for i in range(len(none))), "_range", "_below", "found"])


def rows_of(cells: Column, keys: int, values: int) -> Column:
    """Cells as an array of rows of keys + values cells; what is left over at the end is a shorter row."""
    stride = keys + values
    if stride < 1:
        raise ValueError("Size is too small for the given stride")
    n = F.ceil(F.size(cells) / stride).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(cells, i * stride + 1, stride))
