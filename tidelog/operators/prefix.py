"""Running sums in a global order without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of an order that are summed at one level, and levels below the top one: 64 bits less
#: these leave at most 2^22 rows to the window that sees all of the top.
BITS, LEVELS = 14, 3


def running_sums(df: DataFrame, order: str, sums: dict[str, Column], within: list[str] | None = None) -> DataFrame:
    """Adds each of `sums` as its inclusive running sum by `order`, an integer that differs on
    every row; with `within`, in each group of these columns apart, where it differs.

    A block is the rows of one `order >> 14`, so it holds at most 2^14 of a group.  Blocks are
    summed apart and shifted by the sums of the blocks before, which are found in the same way
    from the blocks' totals.  Nothing runs before the plan does, and nothing depends on
    how rows are dealt."""
    if not sums:
        return df
    groups = within or []
    at = df.withColumn("_block", F.shiftright(F.col(order).cast("long"), BITS))
    inside = Window.partitionBy(*groups, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = at.select("*", *(F.sum(v).over(inside).alias(k) for k, v in sums.items()))
    totals = at.groupBy(*groups, "_block").agg(*(F.sum(v).alias(f"_{k}") for k, v in sums.items()))
    out = local.join(_before(totals, [f"_{k}" for k in sums], groups, LEVELS), [*groups, "_block"])
    return out.select(*df.columns, *((F.col(k) + F.col(f"_{k}")).cast("long").alias(k) for k in sums))


def _before(totals: DataFrame, names: list[str], groups: list[str], levels: int) -> DataFrame:
    """groups, _block and, for each of `names`, the sum over the blocks before."""
    rows = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    if levels == 1:
        rows = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1) if groups else rows
        return totals.select(*groups, "_block", *(F.coalesce(F.sum(n).over(rows), F.lit(0)).alias(n) for n in names))
    up = totals.withColumn("_up", F.shiftright("_block", BITS))
    rows = Window.partitionBy(*groups, "_up").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    local = up.select(*groups, "_block", "_up", *(F.coalesce(F.sum(n).over(rows), F.lit(0)).alias(f"{n}_own") for n in names))
    above = up.groupBy(*groups, "_up").agg(*(F.sum(n).alias(n) for n in names)).withColumnRenamed("_up", "_block")
    shift = _before(above, names, groups, levels - 1).withColumnRenamed("_block", "_up")
    return local.join(shift, [*groups, "_up"]).select(*groups, "_block", *((F.col(n) + F.col(f"{n}_own")).alias(n) for n in names))
