"""The change log as a stream: keep the latest version of each key as changes arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.merge import best


def follow(changes: DataFrame, out: str, checkpoint: str, **trigger):
    """Starts a query that keeps, for each id, the change of the highest _seq.

    `changes` streams (id, _seq, ...).  Each batch appends the keys that have changed to
    the table at `out`; an older change that arrives late loses to the state.  Compare
    `state`, which reads the table."""
    rest = [c for c in changes.columns if c != "id"]
    latest = changes.groupBy("id").agg(F.max_by(F.struct(*rest), "_seq").alias("row")).select("id", "row.*")

    def commit(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return latest.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(commit).start()


def state(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    return best(rows, ["id"], F.struct("_seq", "batch")).drop("batch")
