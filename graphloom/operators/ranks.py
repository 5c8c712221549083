"""Ranks over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.loop import settle


def ranked(rows: DataFrame, *order: str | Column, out: str = "rank", start: int = 1) -> DataFrame:
    """``rows`` numbered from ``start`` in the given order, which must tell rows apart for the numbers to be fixed.

    Rows are dealt to partitions by ranges and sorted there (one shuffle); a row's number is its place in its
    partition plus the rows of the partitions before, of which only the counts are summed up.
    """
    placed = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    # Rows keep their partition and place, since they are read from where they were settled.
    numbered = placed.withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    joined = numbered.withColumn("_part", part).join(F.broadcast(bases), "_part")
    return joined.withColumn(out, F.col("_base") + place + F.lit(start)).drop("_part", "_base", "_at")
