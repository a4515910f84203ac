"""Sequence numbers and surrogate keys for an ordered batch of sets and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.model import DELETE, SET
from tidelog.operators.prefix import running_sums


def stamp(ops: DataFrame, existing: DataFrame | None = None, base_seq: int = 0, base_rid: int = 0, persisted: list[DataFrame] | None = None) -> DataFrame:
    """`ops` (ord, id, op, ...) that have an effect, with _seq and _rid.

    A delete of a key that is not there has no effect and takes no number.  A set of a key
    that is there keeps its _rid; any other set takes the next one.  `existing` (id,
    _rid) holds the keys that are there before the batch: live ones, or with
    tombstones for the rule that a store follows after a reload.  `ord` differs on every row.
    The running sums refer to the marked rows several times; with `persisted` they are made once, and
    put there for the caller to free.
    """
    by_key = Window.partitionBy("id").orderBy("ord")
    prior = F.lag("op").over(by_key)
    if existing is None:
        known = ops.withColumn("_held", F.lit(None).cast("long"))
    else:
        known = ops.join(existing.select("id", F.col("_rid").alias("_held")), "id", "left")
    marked = known.withColumn("_prior", prior)
    there = (F.col("_prior") == SET) | (F.col("_prior").isNull() & F.col("_held").isNotNull())
    there = F.coalesce(there, F.lit(False))
    marked = marked.withColumn("_fresh", (F.col("op") == SET) & ~there).where((F.col("op") == SET) | there)
    if persisted is not None:
        persisted.append(marked := marked.persist())
    numbered = running_sums(marked, "ord", {"_s": F.lit(1), "_f": F.col("_fresh").cast("int")})
    carried = F.max(F.when(F.col("_fresh"), F.lit(base_rid) + F.col("_f"))).over(by_key)
    return numbered.select(*ops.columns, (F.lit(base_seq) + F.col("_s")).cast("long").alias("_seq"), F.coalesce(carried, "_held").cast("long").alias("_rid"))


def deletes(stamped: DataFrame) -> DataFrame:
    return stamped.where(F.col("op") == DELETE)
