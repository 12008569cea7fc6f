"""Weather tables: daily means, quality report, missing-data report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airq.functions.met import wind_direction_from, wind_speed
from airq.operators.reports import unpivot_numeric

VARIABLES = ["temperature", "relative_humidity", "u_wind", "v_wind"]

# Plausible ranges; values outside are flagged and kept.
TEMPERATURE_RANGE, HUMIDITY_RANGE, WIND_FLAG = (-50.0, 60.0), (0.0, 100.0), 60.0


def time_window(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows of an inclusive day range; a plain range test that reaches the scan."""
    return df.where((F.col(column) >= F.lit(start).cast("timestamp"))
                    & (F.col(column) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")))


def clip_weather(df: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    west, south, east, north = bounds
    return df.where(F.col("longitude").between(west, east) & F.col("latitude").between(south, north))


def weather_daily(df: DataFrame) -> DataFrame:
    """Daily means; speed and direction come from the mean components."""
    means = df.groupBy("latitude", "longitude", F.to_date("time").alias("date")).agg(
        *[F.avg(v).alias(v) for v in VARIABLES])
    u, v = F.col("u_wind"), F.col("v_wind")
    return means.withColumns({"wind_speed": wind_speed(u, v),
                              "wind_direction": wind_direction_from(u, v)})


def weather_qc(df: DataFrame) -> DataFrame:
    """Per variable: missing, valid and total values, range, mean, empty times."""
    long = unpivot_numeric(df, VARIABLES, "variable", "value", keep=["time"])
    slices = long.groupBy("variable", "time").agg(
        F.count("value").alias("valid"), F.count(F.lit(1)).alias("total"),
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("value").alias("s"))
    return slices.groupBy("variable").agg(
        (F.sum("total") - F.sum("valid")).alias("nan_count"), F.sum("valid").alias("valid_count"),
        F.sum("total").alias("total_count"),
        ((F.sum("total") - F.sum("valid")) / F.sum("total")).alias("missing_fraction"),
        F.min("lo").alias("min"), F.max("hi").alias("max"),
        (F.sum("s") / F.sum("valid")).alias("mean"),
        F.count(F.when(F.col("valid") == 0, 1)).alias("empty_time_slices"))


def weather_range_flags(df: DataFrame) -> DataFrame:
    """Counts of implausible values; nothing is removed."""
    t, rh = F.col("temperature"), F.col("relative_humidity")
    speed = wind_speed(F.col("u_wind"), F.col("v_wind"))
    return df.agg(
        F.count(F.when(~t.between(*TEMPERATURE_RANGE), 1)).alias("temperature_out_of_range"),
        F.count(F.when(~rh.between(*HUMIDITY_RANGE), 1)).alias("humidity_out_of_bounds"),
        F.count(F.when(speed > WIND_FLAG, 1)).alias("wind_speed_suspicious"),
        F.max(speed).alias("max_wind_speed"))


def weather_missing(daily: DataFrame) -> DataFrame:
    """Per variable: missing values, cells without any value, days without any value."""
    long = unpivot_numeric(daily, VARIABLES, "variable", "value",
                           keep=["latitude", "longitude", "date"])
    cells = long.groupBy("variable", "latitude", "longitude").agg(
        F.count("value").alias("v"), F.count(F.lit(1)).alias("n")).groupBy("variable").agg(
        F.sum(F.col("n") - F.col("v")).alias("isolated_missing_values"),
        F.count(F.when(F.col("v") == 0, 1)).alias("missing_spatial_cells"))
    days = long.groupBy("variable", "date").agg(F.count("value").alias("v")).groupBy(
        "variable").agg(F.count(F.when(F.col("v") == 0, 1)).alias("missing_entire_days"))
    return cells.join(days, "variable")


def weather_missing_days(daily: DataFrame) -> DataFrame:
    """(variable, date) of days on which a variable has no value anywhere."""
    long = unpivot_numeric(daily, VARIABLES, "variable", "value", keep=["date"])
    return long.groupBy("variable", "date").agg(F.count("value").alias("v")).where(
        F.col("v") == 0).drop("v")


def weather_summary(daily: DataFrame) -> DataFrame:
    """Range, mean and population deviation per variable of the daily means."""
    long = unpivot_numeric(daily, [*VARIABLES, "wind_speed"], "variable", "value")
    return long.groupBy("variable").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"))
