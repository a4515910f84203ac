"""Latest version of each key, tombstones, and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.model import DELETE


def best(df: DataFrame, keys: list[str], order: Column, tops: list[str] | None = None) -> DataFrame:
    """For each key the row of the greatest `order`, as a partial and a final aggregation; of the
    columns `tops` the greatest value among the key's rows."""
    tops = tops or []
    rest = [c for c in df.columns if c not in keys and c not in tops]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_best"), *(F.max(c).alias(c) for c in tops))
    return picked.select(*(F.col(c) if c in keys or c in tops else F.col(f"_best.{c}") for c in df.columns))


def last_lines(log: DataFrame, tops: list[str] | None = None) -> DataFrame:
    """Within a block the last line of a key wins, whatever its _seq."""
    return best(log, ["bid", "id"], F.col("line_no"), tops)


def merge_blocks(lines: DataFrame, tops: list[str] | None = None) -> DataFrame:
    """Across blocks the highest _seq of a key wins; of equal ones, the later block's (blocks
    are listed by bid)."""
    return best(lines, ["id"], F.struct("_seq", "bid"), tops)


def current(log: DataFrame, tops: list[str] | None = None) -> DataFrame:
    """One row for each key, tombstones included."""
    return merge_blocks(last_lines(log, tops), tops)


def live(rows: DataFrame) -> DataFrame:
    """Without tombstones; every other operation code counts as live."""
    return rows.where(F.col("_oid") != DELETE)


def tombstones(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("_oid") == DELETE)


def get_many(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Live records of a table of keys (each key once)."""
    return live(rows).join(keys.select(F.col(key).alias("id")).distinct(), "id", "left_semi")


def has_many(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Each row of `keys` with `present` 0 or 1; no record is read."""
    there = live(rows).select(F.col("id").alias(key), F.lit(1).alias("present"))
    return keys.join(there, key, "left").withColumn("present", F.coalesce("present", F.lit(0)))


def missing(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return keys.join(live(rows).select(F.col("id").alias(key)), key, "left_anti")


def get_by_rid(rows: DataFrame, rid: int) -> DataFrame:
    return live(rows).where(F.col("_rid") == rid)


def rid_conflicts(rows: DataFrame) -> DataFrame:
    """Surrogate keys that stand for more than one id: none in a sound store."""
    return rows.groupBy("_rid").agg(F.count("*").alias("n")).where("n > 1")
