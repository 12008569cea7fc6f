"""Station-day aggregation and station registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def daily_mean(df: DataFrame, value: str = "pm25_ug_m3", ordinal: str = "ordinal",
               min_observations: int = 1) -> DataFrame:
    """UTC-day mean per station; days with too few values are left out.

    Descriptive columns come from the first row of the day by ``ordinal``.
    """
    return daily_mean_all(df, value, ordinal).where(
        F.col("observation_count") >= min_observations)


def daily_mean_all(df: DataFrame, value: str = "pm25_ug_m3",
                   ordinal: str = "ordinal") -> DataFrame:
    """Every station-day, including days below the minimum count.

    Texts are grouping keys of a first pass, so that the pass over all rows is
    a hash aggregate; picking the first text sorts only the reduced rows. Sums are
    exact decimals where the values fit, because a mean on a breakpoint must not
    depend on the order of addition.
    """
    exact = F.col(f"`{value}`").try_cast("decimal(38,18)")
    parts = df.groupBy("station_id", F.to_date("timestamp").alias("date"),
                       "country", "source").agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_n"), F.min(ordinal).alias("_first"),
        F.try_sum(exact).alias("_exact"), F.count(exact).alias("_n_exact"),
        F.min_by("latitude", ordinal).alias("latitude"),
        F.min_by("longitude", ordinal).alias("longitude"))
    first = [F.min_by(c, "_first").alias(c) for c in ("latitude", "longitude", "country", "source")]
    n = F.sum("_n")
    mean = F.when(F.sum("_n_exact") == n, (F.try_sum("_exact") / n).cast("double"))
    return parts.groupBy("station_id", "date").agg(
        F.coalesce(mean, F.sum("_sum") / n).alias("pm25_daily"),
        F.sum("_n").alias("observation_count"), *first)


def daily_report(df: DataFrame, value: str = "pm25_ug_m3",
                 min_observations: int = 1) -> DataFrame:
    """Station-days kept and skipped, stations and countries kept."""
    days = daily_mean_all(df, value)
    keep = F.col("observation_count") >= min_observations
    return days.agg(
        F.count(F.when(~keep, 1)).alias("station_days_skipped"),
        F.count(F.when(keep, 1)).alias("station_days_retained"),
        F.countDistinct(F.when(keep, F.col("station_id"))).alias("stations"),
        F.countDistinct(F.when(keep, F.col("country"))).alias("countries"))


def daily_mean_local(df: DataFrame, timezone: str = "Asia/Kolkata",
                     value: str = "PM2.5") -> DataFrame:
    """Mean and count per station and LOCAL calendar day; position of the last row."""
    day = F.to_date(F.from_utc_timestamp("timestamp", timezone)).alias("date")
    return df.groupBy("station_id", day).agg(
        F.avg(f"`{value}`").alias("PM2.5"), F.count(f"`{value}`").alias("observation_count"),
        F.max_by("latitude", "timestamp").alias("latitude"),
        F.max_by("longitude", "timestamp").alias("longitude"))


def station_summary(df: DataFrame, value: str = "PM2.5") -> DataFrame:
    """Last position, row count, time range and missing values per station."""
    return df.groupBy("station_id").agg(
        F.max_by("latitude", "timestamp").alias("latitude"),
        F.max_by("longitude", "timestamp").alias("longitude"),
        F.count("timestamp").alias("observation_count"),
        F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"),
        F.count(F.when(F.col(f"`{value}`").isNull(), 1)).alias("missing_PM25_count"))


def station_registry(daily: DataFrame) -> DataFrame:
    """One row per (station, source, country) from the daily series."""
    return daily.groupBy("station_id", "source", "country").agg(
        F.min_by("latitude", "date").alias("latitude"),
        F.min_by("longitude", "date").alias("longitude"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.sum("observation_count").alias("n_observations"),
        F.count("date").alias("n_days"))


def country_summary(registry: DataFrame) -> DataFrame:
    """Stations and observations per country."""
    return registry.groupBy("country").agg(
        F.countDistinct("station_id").alias("n_stations"),
        F.sum("n_observations").alias("n_observations"))


def export_registry(registry: DataFrame) -> DataFrame:
    """Registry with the first and last day as text, ordered by station."""
    return registry.select(
        "station_id", "source", "country", "latitude", "longitude",
        F.date_format("first_date", "yyyy-MM-dd").alias("first_timestamp"),
        F.date_format("last_date", "yyyy-MM-dd").alias("last_timestamp"),
        "n_observations", "n_days").orderBy("station_id")
