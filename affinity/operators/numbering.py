"""Dense row numbers in a global order without a single-task window.

Rows are dealt out by ranges of the order and sorted inside each range; the
numbers are the place inside the range plus the sizes of the ranges before it
(one small row per range). Only DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: ``monotonically_increasing_id`` has the partition above these bits and the row inside it below.
ROW_BITS = 33


def number_rows(df: DataFrame, *order: Column | str, name: str = "number", start: int = 0,
                ranges: int | None = None) -> DataFrame:
    """``df`` with a long column ``name``: start, start + 1, ... in the given order.

    Rows that tie in ``order`` are numbered in an arbitrary but fixed order; they
    are in one range, so an order with a hot tie should end in a unique column.
    The sorted rows are checkpointed, so numbers survive lost executors."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
                         .withColumn("__at", F.monotonically_increasing_id()))
    of = F.shiftright("__at", ROW_BITS)
    sizes = placed.groupBy(of.alias("__range")).agg(F.count(F.lit(1)).alias("__rows"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = sizes.select("__range", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (placed.withColumn("__range", of).join(F.broadcast(before), "__range")
            .withColumn(name, F.col("__before") + inside + F.lit(start))
            .drop("__range", "__at", "__before"))
