"""Sets of non-negative integers as one-column tables `bit`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.prefix import running_sums

#: Bits of a page: 256 words of 32 bits.
PAGE = 8192


def bitset(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.col(column).cast("long").alias("bit")).where("bit is not null").distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


set_multiple = union
clear_multiple = difference


def probe(bits: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each row of `wanted` (bit, ...) with is_set 0 or 1; repeats stay."""
    return wanted.join(bits.withColumn("is_set", F.lit(1)), "bit", "left").withColumn("is_set", F.coalesce("is_set", F.lit(0)))


def clear_all(bits: DataFrame) -> DataFrame:
    return bits.limit(0)


def iterate(bits: DataFrame) -> DataFrame:
    """Bits in ascending order, `position` from 0."""
    return running_sums(bits, "bit", {"position": F.lit(1)}).select("bit", (F.col("position") - 1).alias("position"))


def capacity(bits: DataFrame, resized: int = 0) -> DataFrame:
    """Bits in the pages that hold any, and those a resize has allocated: not a bit count."""
    pages = bits.select(F.floor(F.col("bit") / PAGE).alias("page"))
    if resized:
        pages = pages.union(bits.sparkSession.range(-(-resized // PAGE)).toDF("page"))
    return pages.distinct().agg((F.count("*") * PAGE).cast("long").alias("capacity"))


def packed(bits: DataFrame) -> DataFrame:
    """Bitmaps of 32,768 bits: bucket, bitmap."""
    n = F.col("bit")
    return bits.groupBy(F.bitmap_bucket_number(n).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bitmap"))


def packed_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def packed_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.select("bucket"), "bucket", "left_semi").union(b.join(a.select("bucket"), "bucket", "left_semi"))
    return both.groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap")).where(F.bitmap_count("bitmap") > 0)
