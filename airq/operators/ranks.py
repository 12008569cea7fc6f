"""Exact order statistics that stay distributed.

``median`` and ``percentile`` collect a group's distinct values in one task,
and an unpartitioned window sorts everything in one task. Here equal values are
counted first and the counted values are put in order by range partitions,
which cut a group that holds most values like any other. Each partition is
summed on its own and begins where the ones before it end; only one total per
group and partition meets in a task. The number of partitions is Spark's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from airq.session import materialize


def distinct_value_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """One row per distinct (group, value) with its exact position.

    Columns: the group columns, ``value``, ``n`` (rows with that value),
    ``below`` (rows of the group with a smaller value) and ``total`` (rows of
    the group). NULL and NaN values are left out. Average rank of a value is
    ``below + (n + 1) / 2``.
    """
    by = by or []
    counted = (
        df.select(*by, F.col(f"`{value}`").cast("double").alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("n"))
    )
    ranged = counted.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by], F.col("_v").asc())
    # Partition numbers must not change between the two passes below.
    held = materialize(ranged.withColumn("_part", F.spark_partition_id()), "value-counts")
    parts = held.groupBy(*by, "_part").agg(F.sum("n").alias("_part_n"))
    group = [F.col(c) for c in by] or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy("_part")
    starts = parts.select(
        *[F.col(c).alias(f"_k_{c}") for c in by], F.col("_part").alias("_k_part"),
        (F.sum("_part_n").over(before) - F.col("_part_n")).alias("_before"),
        F.sum("_part_n").over(Window.partitionBy(*group)).alias("total"))
    within = Window.partitionBy("_part", *by).orderBy("_v")
    local = held.withColumn("_in_part", F.sum("n").over(within) - F.col("n"))
    match = F.col("_part") == F.col("_k_part")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return local.join(starts, match).select(
        *by, F.col("_v").alias(value), "n",
        (F.col("_before") + F.col("_in_part")).alias("below"), "total")


def exact_quantiles(df: DataFrame, value: str, probabilities: dict[str, float],
                    by: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    ``probabilities`` maps output column names to probabilities in [0, 1].
    """
    by = by or []
    ranks = distinct_value_ranks(df, value, by)
    v, below, last = F.col(f"`{value}`"), F.col("below"), F.col("below") + F.col("n") - 1
    picks = []
    for name, p in probabilities.items():
        at = F.lit(float(p)) * (F.col("total") - 1)
        low, high = F.floor(at), F.ceil(at)
        picks += [
            F.max(F.when((below <= low) & (low <= last), v)).alias(f"_lo_{name}"),
            F.max(F.when((below <= high) & (high <= last), v)).alias(f"_hi_{name}"),
            F.max(at - low).alias(f"_w_{name}"),
        ]
    found = ranks.groupBy(*by).agg(*picks)
    return found.select(*by, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
        for n in probabilities])


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Average rank per distinct (group, value), ties sharing their mean rank."""
    return distinct_value_ranks(df, value, by).select(
        *(by or []), value, (F.col("below") + (F.col("n") + 1) / 2.0).alias("avg_rank"))


def benjamini_hochberg(df: DataFrame, p: str, alpha: float = 0.05,
                       flag: str = "significant") -> DataFrame:
    """Mark every p-value up to the largest rank k with p <= alpha * k / m."""
    passing = distinct_value_ranks(df, p).where(
        F.col(f"`{p}`") <= F.lit(alpha) * (F.col("below") + F.col("n")) / F.col("total"))
    cut = passing.agg(F.max(p).alias("c"))
    return df.withColumn(flag, F.coalesce(F.col(p) <= cut.scalar(), F.lit(False)))
