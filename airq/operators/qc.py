"""Quality control: every rejected row keeps the reason of its rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airq.operators.dedupe import keep_first
from airq.operators.ranks import exact_quantiles

# Plausibility limits of the observations.
MAX_PM25 = 1000.0
MAD_TO_SIGMA = 1.4826

STATION_RULES = ["missing_timestamps", "missing_station_ids", "missing_coordinates",
                 "invalid_coordinates", "impossible_coordinates", "missing_pm25",
                 "non_finite_values", "negative_pm25", "invalid_pm25"]
OBSERVATION_RULES = ["invalid_coordinates", "invalid_timestamps", "invalid_units",
                     "missing_pm25", "negative_pm25", "above_max_pm25"]


def _first_failing(rules: list[tuple[str, Column]]) -> Column:
    chain = None
    for name, failed in rules:
        failed = F.coalesce(failed, F.lit(False))
        chain = F.when(failed, F.lit(name)) if chain is None else chain.when(failed, F.lit(name))
    return chain


def _missing(value: Column) -> Column:
    return value.isNull() | F.isnan(value)


def station_qc(df: DataFrame, ordinal: str,
               valid_bounds: tuple[float, float, float, float] | None = None,
               max_pm25: float = MAX_PM25) -> DataFrame:
    """Station network rules, first failing rule wins.

    Adds ``n_rows`` (rows that shared the key; all but the first are
    duplicates) and ``reject_reason`` (NULL for survivors). ``valid_bounds`` is
    (west, south, east, north).
    """
    first = keep_first(df, ["station_id", "timestamp"], ordinal, count_as="n_rows")
    lat, lon, value = F.col("latitude"), F.col("longitude"), F.col("`PM2.5`")
    infinite = float("inf")
    rules = [
        ("missing_timestamps", F.col("timestamp").isNull()),
        ("missing_station_ids", F.col("station_id").isNull()),
        ("missing_coordinates", _missing(lat) | _missing(lon)),
        ("invalid_coordinates", ~(lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0))),
    ]
    if valid_bounds:
        west, south, east, north = valid_bounds
        rules.append(("impossible_coordinates",
                      ~(lat.between(south, north) & lon.between(west, east))))
    rules += [
        ("missing_pm25", _missing(value)),
        ("non_finite_values", F.abs(value) == infinite),
        ("negative_pm25", value < 0),
        ("invalid_pm25", value > max_pm25),
    ]
    return first.withColumn("reject_reason", _first_failing(rules))


def observation_qc(df: DataFrame, ordinal: str, value: str = "pm25_ug_m3",
                   max_pm25: float = MAX_PM25) -> DataFrame:
    """Rules of the worldwide network; units must be named, outliers stay."""
    first = keep_first(df, ["station_id", "timestamp"], ordinal, count_as="n_rows")
    lat, lon, v = F.col("latitude"), F.col("longitude"), F.col(value)
    rules = [
        ("invalid_coordinates",
         ~F.coalesce(lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0), F.lit(False))),
        ("invalid_timestamps", F.col("timestamp").isNull()),
        ("invalid_units", F.col("units").isNull() | (F.col("units") == "")),
        ("missing_pm25", _missing(v)),
        ("negative_pm25", v < 0.0),
        ("above_max_pm25", v > max_pm25),
    ]
    return first.withColumn("reject_reason", _first_failing(rules))


def survivors(checked: DataFrame) -> DataFrame:
    """Rows that passed every rule."""
    return checked.where(F.col("reject_reason").isNull()).drop("reject_reason", "n_rows")


def attrition(checked: DataFrame, rules: list[str]) -> DataFrame:
    """One row: input, duplicates, rows lost per rule, retained."""
    reason = F.col("reject_reason")
    return checked.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("input_rows"),
        F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("duplicate_rows"),
        *[F.count(F.when(reason == r, 1)).alias(r) for r in rules],
        F.count(F.when(reason.isNull(), 1)).alias("retained_rows"),
    )


def mad_outlier_flag(df: DataFrame, value: str, k: float = 5.0, flag: str = "outlier_flag",
                     stats: tuple[float | None, float | None] | None = None) -> DataFrame:
    """Flag |x - median| > k * 1.4826 * MAD over the whole frame.

    A zero MAD flags nothing. Rows are flagged, never removed. ``stats`` takes
    the result of :func:`median_and_mad` where it is known already.
    """
    centre, mad = stats or median_and_mad(df, value)
    if not mad:
        return df.withColumn(flag, F.lit(False))
    far = F.abs(F.col(value) - F.lit(centre)) > F.lit(mad * k)
    return df.withColumn(flag, F.coalesce(far, F.lit(False)))


def median_and_mad(df: DataFrame, value: str) -> tuple[float | None, float | None]:
    """Exact median and scaled MAD as two numbers.

    The second pass needs the first result, so both run when this is called;
    as nested subqueries the input would be read many times. Callers with an
    expensive input should pass a written table.
    """
    centre = exact_quantiles(df, value, {"m": 0.5}).first()
    if centre is None or centre["m"] is None:
        return None, None
    deviations = df.select(F.abs(F.col(value) - F.lit(centre["m"])).alias("d"))
    mad = exact_quantiles(deviations, "d", {"m": 0.5}).first()["m"]
    return centre["m"], mad * MAD_TO_SIGMA


def iqr_outlier_ratio(df: DataFrame, value: str, k: float = 3.0) -> DataFrame:
    """Share of values outside [Q1 - k*IQR, Q3 + k*IQR]; zero when IQR is 0."""
    quartiles = exact_quantiles(df, value, {"q1": 0.25, "q3": 0.75}).select(
        F.struct("q1", "q3").alias("q"))
    values = (df.select(F.col(f"`{value}`").alias("_x")).where(F.col("_x").isNotNull())
              .withColumn("_q", quartiles.scalar()))
    q1, q3 = F.col("_q.q1"), F.col("_q.q3")
    spread = q3 - q1
    outside = (spread > 0) & ((F.col("_x") < q1 - spread * k) | (F.col("_x") > q3 + spread * k))
    return values.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(outside, 1)).alias("n_outliers"),
        F.coalesce(F.avg(outside.cast("double")), F.lit(0.0)).alias("outlier_ratio"))


def observation_summary(df: DataFrame, value: str = "pm25_ug_m3") -> DataFrame:
    """Coverage of the retained rows: date range, stations, countries, values."""
    return df.agg(
        F.count(F.lit(1)).alias("observations"),
        F.countDistinct("station_id").alias("station_count"),
        F.countDistinct("country").alias("country_count"),
        F.to_date(F.min("timestamp")).alias("first_date"),
        F.to_date(F.max("timestamp")).alias("last_date"),
        F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.avg(value).alias("mean_value"),
    )
