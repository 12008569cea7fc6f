"""Time joins: as-of, interval and tolerance matching of dated layers.

Without a key each composite is spread over the days it can serve and reduced to
the best one per day, so what is joined to the large side is bounded by the
calendar. With a key both sides are merged in one ordering instead: blocks of
it carry the last composite along their rows, and what a block ends with is
handed to the next. Neither side is multiplied, and a key that holds most
rows is cut like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from airq.session import materialize, materialize_counting

#: Rows of a block that carries the last composite along, as a power of two.
BLOCK = 17


def _best_per_day(composites: DataFrame, composite_date: str, by: list[str],
                  first_day: Column, last_day: Column) -> DataFrame:
    """Per (key, day): nearest composite, the earlier one on a tie."""
    served = composites.select(*by, F.col(composite_date).alias("_c")).distinct().withColumn(
        "_day", F.explode(F.sequence(first_day, last_day)))
    nearness = F.struct(F.abs(F.datediff("_day", "_c")), F.col("_c"))
    return served.groupBy(*by, "_day").agg(F.min_by("_c", nearness).alias("_c"))


def _attach(targets: DataFrame, target_date: str, best: DataFrame, by: list[str],
            matched: str, offset: str, how: str) -> DataFrame:
    # Written first: with its size known, a small day table is broadcast and the
    # large side stays where it is.
    best = materialize(best.withColumnRenamed("_c", matched), "days")
    out = targets.withColumn("_day", F.col(target_date)).join(best, [*by, "_day"], how)
    return out.withColumn(offset, F.datediff("_day", matched)).drop("_day")


def _merged(targets: DataFrame, target_date: str, composites: DataFrame, composite_date: str, by: list[str],
            back: int, ahead: int, matched: str, offset: str, how: str) -> DataFrame:
    """Per target the nearest composite of its key, at most ``back`` days before or ``ahead`` days after; the earlier on a tie.

    NULL keys and dates match nothing.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    named = [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)]
    row = F.struct(*[F.col(f"`{c}`") for c in targets.columns])
    asked = targets.select(*named, F.col(target_date).cast("date").alias("_d"), row.alias("_row"), F.monotonically_increasing_id().alias("_tie"))
    known = composites.select(*named, F.col(composite_date).cast("date").alias("_d")).dropna().distinct()
    known = known.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)).withColumn("_tie", F.lit(-1).cast("long"))
    # At one date composites come first, and equal rows are told apart so that they can be cut.
    order = [F.col(c).asc_nulls_first() for c in (*keys, "_d", "_tie")]
    held, n = materialize_counting(known.unionByName(asked).repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id()), "merged", F.lit(True))
    # Places count on within a range partition, so their upper bits number blocks of rows in order; a task sorts few of them.
    held = held.withColumn("_part", F.shiftright("_at", BLOCK))
    composite = F.when(F.col("_row").isNull(), F.struct(*keys, F.col("_d").alias("_c")))
    place = F.when(F.col("_row").isNull(), F.col("_at"))
    ends = held.groupBy("_part").agg(F.max_by(composite, place).alias("_last"), F.min_by(composite, place).alias("_first"))
    # One row per block meets in these windows.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = materialize(ends.select("_part", F.last("_last", ignorenulls=True).over(earlier).alias("_brought"),
                                   F.last("_first", ignorenulls=True).over(later).alias("_next")), "ends")
    inside = Window.partitionBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = held.repartition((n >> BLOCK + 1) + 1, "_part").withColumn("_b", F.last(composite, ignorenulls=True).over(inside.orderBy("_at")))
    if ahead:
        found = found.withColumn("_a", F.last(composite, ignorenulls=True).over(inside.orderBy(F.col("_at").desc())))
    found = found.where("_row is not null").join(ends, "_part")

    def date(entry: Column, limit: int) -> Column:
        same = F.lit(True)
        for k in keys:
            same = same & (entry[k] == F.col(k))
        return F.when(same & (F.abs(F.datediff("_d", entry["_c"])) <= limit), entry["_c"])

    best = date(F.coalesce("_b", "_brought"), back)
    if ahead:
        after = date(F.coalesce("_a", "_next"), ahead)
        best = F.when(after.isNull() | (F.datediff("_d", best) <= F.datediff(after, "_d")), best).otherwise(after)
    out = found.select("_row.*", best.alias(matched), F.datediff("_d", best).alias(offset))
    return out if how == "left" else out.where(F.col(matched).isNotNull())


def asof_composite(targets: DataFrame, composites: DataFrame, target_date: str,
                   composite_date: str, by: list[str] | None = None,
                   max_lookback_days: int = 32, no_future: bool = True,
                   matched: str = "composite_date", offset: str = "offset_days",
                   how: str = "left") -> DataFrame:
    """Nearest composite that starts on or before the date, within the lookback.

    With ``no_future=False`` later composites count too; on equal distance the
    earlier one wins. The offset is date minus composite start, in days.
    """
    by = by or []
    if by:
        return _merged(targets, target_date, composites, composite_date, by, max_lookback_days,
                       0 if no_future else max_lookback_days, matched, offset, how)
    c = F.col("_c")
    first = c if no_future else F.date_sub(c, max_lookback_days)
    best = _best_per_day(composites, composite_date, by, first, F.date_add(c, max_lookback_days))
    return _attach(targets, target_date, best, by, matched, offset, how)


def interval_composite(targets: DataFrame, composites: DataFrame, target_date: str,
                       start_date: str, period_days: int = 16,
                       tolerance_days: int | None = None, by: list[str] | None = None,
                       matched: str = "composite_date", offset: str = "offset_days",
                       how: str = "left") -> DataFrame:
    """Composite whose [start, start + period) contains the date."""
    by = by or []
    span = period_days - 1 if tolerance_days is None else min(period_days - 1, tolerance_days)
    if by:
        return _merged(targets, target_date, composites, start_date, by, span, 0, matched, offset, how)
    c = F.col("_c")
    best = _best_per_day(composites, start_date, by, c, F.date_add(c, span))
    return _attach(targets, target_date, best, by, matched, offset, how)


def tolerance_match(targets: DataFrame, observed: DataFrame, target_date: str,
                    observed_date: str, tolerance_days: int = 3, by: list[str] | None = None,
                    matched: str = "observed_date", offset: str = "offset_days",
                    how: str = "left") -> DataFrame:
    """Nearest observation within the tolerance on either side.

    The offset is signed and ``no_future`` tells whether the match lies on or
    before the date, so a look-ahead can be seen and refused.
    """
    by = by or []
    if by:
        out = _merged(targets, target_date, observed, observed_date, by, tolerance_days, tolerance_days, matched, offset, how)
    else:
        c = F.col("_c")
        best = _best_per_day(observed, observed_date, by, F.date_sub(c, tolerance_days),
                             F.date_add(c, tolerance_days))
        out = _attach(targets, target_date, best, by, matched, offset, how)
    return out.withColumn("no_future", F.col(offset) >= 0)


def composite_start(date: Column, period_days: int = 16, anchor: str = "2000-02-18") -> Column:
    """Start of the fixed-period composite that contains a date."""
    days = F.datediff(date, F.lit(anchor).cast("date"))
    return F.date_add(F.lit(anchor).cast("date"),
                      (F.floor(days / period_days) * period_days).cast("int"))
