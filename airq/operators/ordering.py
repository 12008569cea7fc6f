"""Positions in a total order without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from airq.session import materialize

#: Bits of ``monotonically_increasing_id`` that number the rows of one partition.
WITHIN = 33


def numbered(df: DataFrame, order: list[Column], position: str = "pos") -> DataFrame:
    """Add ``position`` = 0..n-1 in ``order``; a stored table is behind the result.

    Range partitions are sorted by themselves; each begins where the ones before
    it end. Only one count per partition meets in a task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id())
    held = materialize(ranged, "numbered")
    counts = held.groupBy(F.shiftright("_at", WITHIN).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begins = materialize(counts.select("_part", F.coalesce(before, F.lit(0)).alias("_begin")), "begins")
    return held.withColumn("_part", F.shiftright("_at", WITHIN)).join(begins, "_part").withColumn(
        position, F.col("_begin") + F.col("_at") - F.shiftleft("_part", WITHIN)).drop("_part", "_begin", "_at")
