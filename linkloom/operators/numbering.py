"""Consecutive numbers over a whole ordered table, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

# ``monotonically_increasing_id`` holds the partition above these bits and the place in it below.
_PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[Column], name: str = "n", start: int = 0) -> DataFrame:
    """``rows`` with the column ``name`` counting from ``start`` in ``order``.

    The rows are dealt by range and sorted, each writes its place in its partition along, and the counts of
    the partitions before (one row per partition) are added when the table is read again. ``order`` should
    end in a unique column: equal keys share a partition. No rows give no rows.
    """
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = stage(laid.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", _PLACE_BITS).alias("_part")
    counts = laid.groupBy(part).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    placed = laid.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    number = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + F.lit(start)
    return placed.withColumn(name, number).drop("_part", "_before", "_place")
