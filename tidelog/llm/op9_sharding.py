"""Contiguous shards of near equal bytes, cut from a global prefix sum of sizes.

Documents stand in the order of their ids (ties: by size and checksum).  Each range
partition adds up its own sizes, the partitions' totals shift them to global offsets, and
a document goes to the shard in whose equal share of all bytes it starts.  No text moves:
sizes and checksums are made in the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import running


def byte_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, size (UTF-8 bytes of the text and 1; null: 1),
    text_crc32, shard (0 to shards - 1) and slot (its place in the shard, from 0).

    Shard sizes differ from an equal share by less than the largest document.  Repeated
    rows and ids each keep a slot of their own; an empty table gives no rows; other
    columns are ignored.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = running(sized, ["doc_id", "size", "text_crc32"], ["size"], "shards")
    total = placed.agg(F.sum("size")).first()[0] or 1
    # start * shards may pass 2^63 beyond 5e17 bytes, hence the decimal
    shard = F.least(F.lit(shards - 1), F.floor(F.col("size_start").cast("decimal(38,0)") * shards / F.lit(total).cast("decimal(38,0)")).cast("int"))
    cut = placed.withColumn("shard", shard)
    firsts = cut.groupBy("shard").agg(F.min("row_start").alias("_first"))  # one row for each shard
    return cut.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row_start") - F.col("_first")).alias("slot"))
