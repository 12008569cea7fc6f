"""The gate before training: measured values against thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airq.functions.status import all_present
from airq.operators.ranks import exact_quantiles
from airq.schemas import TARGET

# Default thresholds of the gate.
THRESHOLDS = {
    "min_complete_rows": 1000, "min_stations": 20, "min_countries": 5, "min_temporal_days": 30,
    "min_unique_latitudes": 3, "min_unique_longitudes": 3, "min_daily_completeness_pct": 50.0,
    "max_outlier_ratio": 0.10, "max_missing_target_ratio": 0.05,
}

# Features a source must bring and the least share of rows in percent.
SOURCE_REQUIREMENTS = {
    "pm25": ([TARGET], 80.0),
    "aod": (["AOD"], 40.0),
    "weather": (["temperature_c", "relative_humidity_pct", "wind_speed_mps",
                 "wind_direction_deg"], 40.0),
    "ndvi": (["NDVI"], 30.0),
    "dem": (["elevation_m"], 50.0),
    "osm": (["road_density"], 50.0),
    "viirs": (["night_lights"], 30.0),
}


def _measures(df: DataFrame) -> DataFrame:
    """Every measured value in one row: one pass plus the exact quartiles."""
    t = F.col(f"`{TARGET}`")
    quartiles = exact_quantiles(df, TARGET, {"q1": 0.25, "q3": 0.75}).select(
        F.struct("q1", "q3").alias("q"))
    fenced = df.withColumn("_q", quartiles.scalar())
    spread = F.col("_q.q3") - F.col("_q.q1")
    outside = (spread > 0) & ((t < F.col("_q.q1") - spread * 3.0) | (t > F.col("_q.q3") + spread * 3.0))
    n = F.count(F.lit(1))
    row = fenced.agg(
        n.alias("rows"), F.count(F.when(F.col("complete_case"), 1)).alias("complete"),
        F.countDistinct("station_id").alias("stations"), F.countDistinct("country").alias("countries"),
        F.countDistinct("date").alias("days"), F.countDistinct("latitude").alias("lats"),
        F.countDistinct("longitude").alias("lons"),
        (F.datediff(F.max("date"), F.min("date")) + 1).alias("span"),
        F.coalesce(F.count(F.when(t.isNull(), 1)) / n, F.lit(0.0)).alias("missing_ratio"),
        F.coalesce(F.count(F.when(outside, 1)) / F.count(t), F.lit(0.0)).alias("outlier_ratio"),
        *[(F.lit(100.0) * F.count(F.when(all_present(cols), 1)) / n).alias(f"cov_{s}")
          for s, (cols, _) in SOURCE_REQUIREMENTS.items()])
    completeness = F.lit(100.0) * F.col("days") / F.greatest(F.col("span"), F.lit(1))
    ready = sum(((F.col(f"cov_{s}") >= least).cast("int")
                 for s, (_, least) in SOURCE_REQUIREMENTS.items()), F.lit(0))
    return row.withColumns({"completeness": completeness, "sources_ready": ready})


def readiness_checks(df: DataFrame, thresholds: dict | None = None,
                     pm25_fresh: bool | None = None) -> DataFrame:
    """One row per check: measured, threshold, passed and reason.

    ``source_*`` rows explain ``feature_sources_ready``; they are details and
    take no part in the score. Freshness passes when nothing is known about it.
    """
    th = {**THRESHOLDS, **(thresholds or {})}
    n_sources = len(SOURCE_REQUIREMENTS)

    def at_least(measured: Column, least: float) -> tuple[Column, Column, Column]:
        return measured.cast("double"), F.lit(float(least)), measured >= least

    def at_most(measured: Column, most: float) -> tuple[Column, Column, Column]:
        return measured.cast("double"), F.lit(float(most)), measured <= most

    positions = F.least(F.col("lats") - th["min_unique_latitudes"],
                        F.col("lons") - th["min_unique_longitudes"])
    checks = {
        "complete_case_rows": at_least(F.col("complete"), th["min_complete_rows"]),
        "stations": at_least(F.col("stations"), th["min_stations"]),
        "countries": at_least(F.col("countries"), th["min_countries"]),
        "temporal_days": at_least(F.col("days"), th["min_temporal_days"]),
        "spatial_coverage": at_least(positions, 0),
        "temporal_coverage": at_least(F.col("completeness"), th["min_daily_completeness_pct"]),
        "missing_target": at_most(F.col("missing_ratio"), th["max_missing_target_ratio"]),
        "outliers": at_most(F.col("outlier_ratio"), th["max_outlier_ratio"]),
        "feature_sources_ready": at_least(F.col("sources_ready"), n_sources),
        "data_freshness": (F.lit(None if pm25_fresh is None else float(pm25_fresh)).cast("double"),
                           F.lit(1.0), F.lit(pm25_fresh is not False)),
    }
    details = {f"source_{s}": at_least(F.col(f"cov_{s}"), least)
               for s, (_, least) in SOURCE_REQUIREMENTS.items()}
    items = F.array(*[
        F.struct(F.lit(name).alias("check"), F.lit(name in checks).alias("gating"),
                 m.alias("measured"), t.alias("threshold"), F.coalesce(ok, F.lit(False)).alias("passed"))
        for name, (m, t, ok) in {**checks, **details}.items()])
    rows = _measures(df).select(F.explode(items).alias("r")).select("r.*")
    reason = F.concat_ws(" ", F.col("check"), F.format_number("measured", 2), F.lit("vs"),
                         F.format_number("threshold", 2))
    return rows.withColumn("reason", F.when(~F.col("passed"), reason))


def readiness_verdict(checks: DataFrame) -> DataFrame:
    """YES only when every gating check passes; score over checks with a verdict.

    ``score_all`` also counts the ungraded source overview, as the older report
    did, and therefore cannot reach 100.
    """
    gate = checks.where("gating")
    passed = F.count(F.when(F.col("passed"), 1))
    quality = F.col("check").isin("missing_target", "outliers")
    # The two quality rows are one check of the score.
    grouped = gate.groupBy(F.when(quality, "quality_flags").otherwise(F.col("check")).alias("c")).agg(
        F.min("passed").alias("passed"),
        F.max(F.when(~F.col("passed"), F.col("check"))).alias("failed"))
    return grouped.agg(
        F.when(F.min("passed"), "YES").otherwise("NO").alias("model_training_ready"),
        (F.lit(100.0) * passed / F.count(F.lit(1))).alias("score"),
        (F.lit(100.0) * passed / (F.count(F.lit(1)) + 1)).alias("score_all"),
        F.array_join(F.array_sort(F.collect_set("failed")), "; ").alias("failed_checks"))
