"""Positions of rows in a total order, and prefix sums of positions' parts, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from airq.llm.common import store

#: Bits of ``monotonically_increasing_id`` that number the rows of one partition.
WITHIN = 33


def numbered(rows: DataFrame, order: list[Column], name: str, tie: str | None = None) -> DataFrame:
    """``rows`` with ``position``, 0 for the first in ``order``; a stored table is behind it.

    Range partitions are sorted by themselves and begin where the ones before end; what meets in one task is a count per
    partition. ``tie`` names a column that parts rows which are equal in ``order``, so that many equal rows are cut too.
    """
    keys = [*order, *([F.col(tie).asc()] if tie else [])]
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    held, _ = store(sorted_, name)
    part = F.shiftright("_at", WITHIN)
    counts = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begins, _ = store(counts.select("_part", F.coalesce(before, F.lit(0)).alias("_begin")), f"{name}-begins")
    return held.withColumn("_part", part).join(begins, "_part").withColumn(
        "position", F.col("_begin") + F.col("_at") - F.shiftleft("_part", WITHIN)).drop("_part", "_begin", "_at")
