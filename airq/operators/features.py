"""Joining observations with gridded layers and building the training table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from airq.functions.geo import SCOPES, tile_id
from airq.functions.met import temporal_features, wind_u, wind_v
from airq.functions.status import all_present, count_present
from airq.schemas import AVAILABILITY, FEATURES, SOURCE_FEATURES, TARGET, TRAINING_SCHEMA


def join_obs_features(obs: DataFrame, features: DataFrame,
                      keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(matched rows, one-row count of observations without features)."""
    unmatched = obs.join(features.select(*keys), keys, "left_anti").agg(
        F.count(F.lit(1)).alias("unmatched_rows"))
    return obs.join(features, keys, "inner"), unmatched


def attach_feature(obs: DataFrame, layer: DataFrame | None, feature: str,
                   keys: list[str]) -> DataFrame:
    """Add a layer's value at the row's cell and its availability flag.

    Without a layer the value is NULL and the flag false. ``layer`` is unique
    in ``keys``.
    """
    if layer is None:
        out = obs.withColumn(feature, F.lit(None).cast("double"))
    else:
        out = obs.join(layer.select(*keys, F.col(feature).cast("double").alias(feature)),
                       keys, "left")
    return out.withColumn(f"{feature}_available", F.col(feature).isNotNull())


def attach_features(obs: DataFrame, layers: dict[str, DataFrame | None],
                    keys: list[str]) -> DataFrame:
    for feature, layer in layers.items():
        obs = attach_feature(obs, layer, feature, keys)
    return obs


def station_geo_index(obs: DataFrame, order: str) -> DataFrame:
    """First position and country per station; region and city derived from them."""
    return obs.groupBy("station_id").agg(
        F.min_by("latitude", order).alias("latitude"),
        F.min_by("longitude", order).alias("longitude"),
        F.min_by("country", order).alias("country"),
    ).withColumns({"region": F.col("country"), "city": F.col("station_id")})


def master_features(cells: DataFrame, start: str, end: str, static: DataFrame,
                    dated: DataFrame) -> DataFrame:
    """Cell-day feature table: static layers by cell, dated layers by cell and day."""
    from airq.operators.grid import grid_date_scaffold
    return (grid_date_scaffold(cells, start, end)
            .join(static, ["row", "col"], "left").join(dated, ["row", "col", "date"], "left"))


def build_training_table(daily: DataFrame, layers: DataFrame | None = None,
                         road_tiles: DataFrame | None = None, scope: str = "global") -> DataFrame:
    """Station-days in the fixed 38-column order; unavailable features are NULL.

    Gridded features and NDVI provenance may be columns of ``daily`` already, or
    come from ``layers``, which is unique in (station_id, date). Road density
    falls back to tile counts.
    """
    known = {f.name for f in TRAINING_SCHEMA} - {TARGET}
    base = daily.select(
        *[c for c in daily.columns if c in known],
        F.col("pm25_daily").cast("double").alias(TARGET))
    if layers is not None:
        base = base.join(layers, ["station_id", "date"], "left")
    if road_tiles is not None and "road_density" not in base.columns:
        bounds = SCOPES[scope]
        base = base.withColumn("_tile", tile_id(
            F.col("longitude"), F.col("latitude"), 10.0, *bounds))
        counts = road_tiles.select(F.col("tile_id").alias("_tile"),
                                   F.col("road_segments").cast("double").alias("road_density"))
        base = base.join(counts, "_tile", "left").drop("_tile")
    types = {f.name: f.dataType for f in TRAINING_SCHEMA}
    absent = [c for c in types if c not in base.columns]
    base = base.withColumns({c: F.lit(None).cast(types[c]) for c in absent})
    base = base.withColumns(temporal_features(F.col("date"))).withColumns({
        "wind_u_mps": wind_u(F.col("wind_speed_mps"), F.col("wind_direction_deg")),
        "wind_v_mps": wind_v(F.col("wind_speed_mps"), F.col("wind_direction_deg"))})
    base = base.withColumns({a: F.col(f).isNotNull()
                             for a, f in zip(AVAILABILITY, SOURCE_FEATURES)})
    base = base.withColumns({
        "complete_case": all_present([TARGET, *FEATURES]),
        "n_features_available": count_present(SOURCE_FEATURES)})
    return base.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) for c in types])


def empty_training_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TRAINING_SCHEMA)


def valid_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.where(F.col(f"`{target}`") >= 0)


def complete_cases(df: DataFrame, features: list[str]) -> DataFrame:
    return df.where(all_present(features))


def without_aod(features: list[str]) -> list[str]:
    """Fallback feature set for regions and days without optical depth."""
    return [f for f in features if f != "AOD"]


def check_training_schema(df: DataFrame) -> list[str]:
    """Columns that are missing or of the wrong type; empty when all is well."""
    have = {f.name: f.dataType for f in df.schema}
    return [f.name for f in TRAINING_SCHEMA if have.get(f.name) != f.dataType]


def predicted_vs_observed(obs: DataFrame, predictions: DataFrame,
                          keys: list[str]) -> DataFrame:
    """Matched station cells and the mean absolute error of a prediction day."""
    joined = obs.join(predictions.select(*keys, "predicted_PM25"), keys, "left")
    return joined.agg(
        F.count("predicted_PM25").alias("n_station_cells_matched"),
        F.avg(F.abs(F.col(f"`{TARGET}`") - F.col("predicted_PM25"))).alias("station_mae"))
