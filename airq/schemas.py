"""Column lists and fixed schemas shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

TARGET = "PM2.5"

OBSERVATION_SCHEMA = T.StructType([
    T.StructField("station_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("PM2.5", T.DoubleType()),
    T.StructField("units", T.StringType()),
    T.StructField("quality_flag", T.StringType()),
])

IDENTITY = ["station_id", "station_name", "country", "city",
            "latitude", "longitude", "date"]
GRIDDED_FEATURES = ["AOD", "temperature_c", "relative_humidity_pct",
                    "wind_speed_mps", "wind_direction_deg", "NDVI",
                    "elevation_m", "road_density", "night_lights"]
WIND_FEATURES = ["wind_u_mps", "wind_v_mps"]
TEMPORAL_FEATURES = ["month", "day_of_year", "sin_day_of_year", "cos_day_of_year"]
SOURCE_FEATURES = GRIDDED_FEATURES + WIND_FEATURES
FEATURES = SOURCE_FEATURES + TEMPORAL_FEATURES
AVAILABILITY = [f"{name}_available" for name in SOURCE_FEATURES]
RESIDUAL_FEATURES = ["NDVI", "elevation_m", "road_density", "night_lights"]


def _training_field(name: str) -> T.StructField:
    if name in ("station_id", "station_name", "country", "city"):
        return T.StructField(name, T.StringType())
    if name in ("date", "NDVI_source_date"):
        return T.StructField(name, T.DateType())
    if name in ("NDVI_offset_days", "n_features_available"):
        return T.StructField(name, T.IntegerType())
    if name == "complete_case" or name.endswith("_available"):
        return T.StructField(name, T.BooleanType())
    return T.StructField(name, T.DoubleType())


TRAINING_SCHEMA = T.StructType([
    _training_field(name)
    for name in IDENTITY + [TARGET] + FEATURES + AVAILABILITY
    + ["NDVI_source_date", "NDVI_offset_days", "complete_case",
       "n_features_available"]
])

# Nested location and measurement pages as an observation provider returns them.
LOCATION_PAGE_SCHEMA = T.StructType([
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("coordinates", T.StructType([
            T.StructField("latitude", T.DoubleType()),
            T.StructField("longitude", T.DoubleType())])),
        T.StructField("country", T.StructType([
            T.StructField("code", T.StringType()),
            T.StructField("name", T.StringType())])),
        T.StructField("sensors", T.ArrayType(T.StructType([
            T.StructField("id", T.LongType()),
            T.StructField("parameter", T.StructType([
                T.StructField("name", T.StringType()),
                T.StructField("units", T.StringType())])),
            T.StructField("datetimeLast", T.StructType([
                T.StructField("utc", T.StringType())])),
        ]))),
    ]))),
])

ROAD_TILE_SCHEMA = T.StructType([
    T.StructField("tile_id", T.StringType()),
    T.StructField("road_segments", T.LongType()),
])
