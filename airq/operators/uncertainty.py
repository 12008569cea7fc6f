"""Uncertainty from three sources: residuals, feature gaps, distance to stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airq.operators.ranks import exact_quantiles
from airq.schemas import GRIDDED_FEATURES

MIN_RESIDUALS = 10


def residual_uncertainty(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """RMSE, MAE and interquartile range of residuals; DEFERRED below ten."""
    res = df.select((F.col(f"`{observed}`") - F.col(f"`{predicted}`")).alias("r")).where(
        F.col("r").isNotNull())
    q = exact_quantiles(res, "r", {"q1": 0.25, "q3": 0.75}).select(
        (F.col("q3") - F.col("q1")).alias("iqr")).scalar()
    row = res.agg(F.count("r").alias("n_residuals"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rmse"),
                  F.avg(F.abs("r")).alias("mae")).withColumn("iqr", q)
    enough = F.col("n_residuals") >= MIN_RESIDUALS
    return row.select(
        F.when(enough, "ESTIMATED").otherwise("DEFERRED").alias("status"), "n_residuals",
        *[F.when(enough, F.round(c, 2)).alias(f"{c}_ug_m3") for c in ("rmse", "mae", "iqr")])


def feature_gap_uncertainty(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Mean share of missing features per row and rows with gaps."""
    features = features or GRIDDED_FEATURES
    gaps = sum((F.col(f"`{f}`").isNull().cast("int") for f in features), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("total_cells"), F.count(F.when(gaps > 0, 1)).alias("cells_with_gaps"),
        F.round(F.avg(gaps * 100.0 / len(features)), 1).alias("mean_missing_features_pct"),
    ).withColumn("status", F.when(F.col("total_cells") > 0, "ESTIMATED").otherwise("DEFERRED"))


def distance_uncertainty(distances: DataFrame, distance: str = "distance_km") -> DataFrame:
    """Median and greatest distance from a cell to its nearest station."""
    median = exact_quantiles(distances, distance, {"m": 0.5}).scalar()
    row = distances.agg(F.count(distance).alias("n_cells"), F.max(distance).alias("mx"))
    return row.withColumn("md", median).select(
        F.when(F.col("n_cells") > 0, "ESTIMATED").otherwise("DEFERRED").alias("status"), "n_cells",
        F.round("md", 1).alias("median_distance_to_station_km"),
        F.round("mx", 1).alias("max_distance_to_station_km"))


def uncertainty_score(residual: DataFrame, gaps: DataFrame, distance: DataFrame) -> DataFrame:
    """Overall status and mean of the parts on a 0..100 error scale."""
    def one(df: DataFrame, *columns: str):
        return df.select(F.struct(*columns).alias("s")).scalar()

    # residual is a one-row frame; the others enter as scalars.
    row = residual.select(F.col("status").alias("s1"), F.col("rmse_ug_m3").alias("rmse")).withColumns({
        "g": one(gaps, "status", "mean_missing_features_pct"),
        "d": one(distance, "status", "max_distance_to_station_km")})
    parts = F.array_compact(F.array(
        F.when((F.col("s1") == "ESTIMATED") & (F.col("rmse") != 0),
               F.least(F.col("rmse") / 100.0, F.lit(1.0)) * 100.0),
        F.when(F.col("g.status") == "ESTIMATED", F.col("g.mean_missing_features_pct")),
        F.when(F.col("d.status") == "ESTIMATED",
               F.least(F.col("d.max_distance_to_station_km") / 50.0, F.lit(1.0)) * 100.0)))
    deferred = ((F.col("s1") == "DEFERRED").cast("int") + (F.col("g.status") == "DEFERRED").cast("int")
                + (F.col("d.status") == "DEFERRED").cast("int"))
    total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x)
    return row.withColumn("parts", parts).select(
        F.when(deferred == 3, "DEFERRED").when(deferred == 0, "ESTIMATED")
        .otherwise("PARTIAL").alias("status"),
        F.when(F.size("parts") > 0, F.round(total / F.size("parts"), 1)).alias("uncertainty_score"),
        F.size("parts").cast("bigint").alias("n_components"))
