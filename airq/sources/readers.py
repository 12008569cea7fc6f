"""Station files, weather tables, vectors and road tiles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from airq.functions.geo import in_bbox
from airq.functions.units import kelvin_to_celsius, null_if_nan
from airq.schemas import OBSERVATION_SCHEMA, ROAD_TILE_SCHEMA

# Accepted header names per field, first match wins.
STATION_ALIASES = {
    "station_id": ["station_id", "station", "station_name", "site_id", "site", "id"],
    "timestamp": ["timestamp", "date", "datetime", "from_date", "fromdate", "time"],
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "lon", "lng"],
    "PM2.5": ["PM2.5", "PM25", "pm2.5", "pm25", "pm2_5"],
}
WEATHER_ALIASES = {
    "time": ["time", "valid_time"],
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "lon", "long"],
    "temperature": ["temperature_2m", "t2m", "2m_temperature", "temperature"],
    "relative_humidity": ["relative_humidity", "rh", "2m_relative_humidity", "r2m"],
    "u_wind": ["u10", "10m_u_component_of_wind", "u_component_of_wind_10m", "u_wind"],
    "v_wind": ["v10", "10m_v_component_of_wind", "v_component_of_wind_10m", "v_wind"],
}
# Names of the second network's export; a location names the station.
OPENAQ_ALIASES = {
    "station_id": ["location", "city"], "timestamp": ["datetime"], "PM2.5": ["value"],
    "latitude": ["latitude", "lat"], "longitude": ["longitude", "lon"],
}


def bare_name(name: str) -> str:
    """Header name without case and separators."""
    return re.sub(r"[ _.\-]", "", str(name).lower())


def resolve_columns(columns: list[str], aliases: dict[str, list[str]],
                    configured: dict[str, str] | None = None) -> tuple[dict[str, str], list[str]]:
    """({field: actual column}, unresolved fields). A configured name is tried first."""
    by_name = {bare_name(c): c for c in columns}
    found, missing = {}, []
    for field, names in aliases.items():
        wanted = [(configured or {}).get(field), *names]
        hit = next((by_name[bare_name(w)] for w in wanted if w and bare_name(w) in by_name), None)
        if hit is None:
            missing.append(field)
        else:
            found[field] = hit
    return found, missing


def rename_resolved(df: DataFrame, aliases: dict[str, list[str]],
                    configured: dict[str, str] | None = None,
                    required: list[str] | None = None) -> DataFrame:
    """Rename to field names; raise when a required field cannot be found."""
    found, missing = resolve_columns(df.columns, aliases, configured)
    lost = [m for m in missing if required is None or m in required]
    if lost:
        raise ValueError(f"cannot detect fields {lost} in columns {df.columns}")
    names = {actual: field for field, actual in found.items()}
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns
                       if c in names or c not in found])


def coerce_timestamp(text: Column, timezone: str = "UTC") -> Column:
    """Instant of a text: zoned texts as they say, naive texts in ``timezone``.

    Unreadable text gives NULL.
    """
    parsed = F.try_to_timestamp(text)
    zoned = text.rlike(r"(?i)\d(z|utc|gmt|[+-]\d{2}:?\d{2})\s*$")
    return F.when(zoned, parsed).otherwise(F.to_utc_timestamp(parsed, timezone))


def coerce_station_types(df: DataFrame, timezone: str = "Asia/Kolkata") -> DataFrame:
    """Typed columns from all-text ones; what cannot be read is NULL."""
    return df.withColumns({
        "timestamp": coerce_timestamp(F.col("timestamp"), timezone),
        "latitude": null_if_nan(F.col("latitude").try_cast("double")),
        "longitude": null_if_nan(F.col("longitude").try_cast("double")),
        "PM2.5": null_if_nan(F.col("`PM2.5`").try_cast("double"))})


def read_station_csv(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8",
                     sep: str = ",", timezone: str = "Asia/Kolkata",
                     configured: dict[str, str] | None = None) -> DataFrame:
    """Station observations from CSV, all columns text first, then typed.

    Encoding and separator belong to a source; :func:`sniff_csv` finds them.
    """
    raw = (spark.read.option("header", True).option("inferSchema", False)
           .option("encoding", encoding).option("sep", sep).csv(path))
    return coerce_station_types(rename_resolved(raw, STATION_ALIASES, configured), timezone)


def sniff_csv(spark: SparkSession, path: str) -> tuple[str, str]:
    """(encoding, separator) of a source, judged by its lines and its header."""
    lines = spark.read.text(path)
    first = lines.first()
    header = first[0] if first else ""
    broken = not lines.where(~F.is_valid_utf8("value")).isEmpty()
    sep = max([",", ";", "\t", "|"], key=header.count)
    return ("ISO-8859-1" if broken else "UTF-8"), sep


def normalize_weather(df: DataFrame, time_column_type: str = "timestamp") -> DataFrame:
    """Weather long table with canonical names and NULL for NaN; other columns are dropped.

    Where a column ``temperature_units`` says how, temperatures become Celsius.
    """
    named = rename_resolved(df, WEATHER_ALIASES)
    values = {c: null_if_nan(F.col(c).cast("double")) for c in WEATHER_ALIASES if c != "time"}
    if "temperature_units" in df.columns:
        values["temperature"] = kelvin_to_celsius(values["temperature"], F.col("temperature_units"))
    return named.select(F.col("time").cast(time_column_type), *[v.alias(c) for c, v in values.items()])


def ingest_tabular(spark: SparkSession, path: str, bounds: tuple[float, float, float, float],
                   fmt: str = "parquet") -> DataFrame:
    """Rows of a table inside a box; the range test reaches the Parquet row groups."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    df = reader.format(fmt).load(path)
    if fmt == "csv":
        df = df.withColumns({c: F.col(c).try_cast("double") for c in ("longitude", "latitude")})
    inside = df.where(in_bbox(F.col("longitude"), F.col("latitude"), bounds))
    return inside.select(*[null_if_nan(F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`")
                           for c, t in inside.dtypes])


def ingest_vector(spark: SparkSession, path: str,
                  bounds: tuple[float, float, float, float]) -> DataFrame:
    """Line features of GeoJSON collections whose bounding box meets a box."""
    schema = ("features array<struct<properties:map<string,string>,"
              "geometry:struct<type:string,coordinates:array<array<double>>>>>")
    features = spark.read.schema(schema).option("multiLine", True).json(path).select(
        F.explode("features").alias("f"))
    coords = F.transform("f.geometry.coordinates", lambda p: F.struct(
        F.try_element_at(p, F.lit(1)).alias("x"), F.try_element_at(p, F.lit(2)).alias("y")))
    lines = features.select(
        F.col("f.properties").alias("properties"),
        F.try_element_at("f.properties", F.lit("highway")).alias("highway"), coords.alias("coords"))
    return lines_in_box(lines, bounds)


def lines_in_box(lines: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Lines whose bounding box meets a box."""
    west, south, east, north = bounds
    xs, ys = F.transform("coords", lambda p: p.x), F.transform("coords", lambda p: p.y)
    return lines.where((F.array_min(xs) <= east) & (F.array_max(xs) >= west)
                       & (F.array_min(ys) <= north) & (F.array_max(ys) >= south))


def read_road_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Tile name and road count from one JSON file per tile.

    Unreadable files and files without a tile name are skipped; of several
    files for a tile the last by name counts.
    """
    raw = (spark.read.schema(ROAD_TILE_SCHEMA).option("multiLine", True)
           .option("pathGlobFilter", "roads_tile_*.json").option("mode", "PERMISSIVE")
           .json(folder).select("*", F.col("_metadata.file_name").alias("file_name")))
    return raw.where(F.col("tile_id").isNotNull() & (F.col("tile_id") != "")).groupBy("tile_id").agg(
        F.max_by(F.coalesce("road_segments", F.lit(0)), "file_name").alias("road_segments"))


def union_ground_truth(networks: dict[str, DataFrame], tags: dict[str, dict[str, str]],
                       ordinal: str) -> DataFrame:
    """Common observation table of several networks.

    Each network is tagged with source, country, units and quality flag.
    Incomplete and impossible rows go, the first row per (station, source,
    timestamp) stays.
    """
    from airq.operators.dedupe import keep_first
    names = [f.name for f in OBSERVATION_SCHEMA]
    union = None
    for source, df in networks.items():
        tagged = df.withColumn("source", F.lit(source))
        for column in ("country", "units", "quality_flag"):
            value = tags.get(source, {}).get(column)
            if value is not None or column not in tagged.columns:
                tagged = tagged.withColumn(column, F.lit(value).cast("string"))
        part = tagged.select(*[F.col(f"`{n}`").cast(t.dataType).alias(n)
                               for n, t in zip(names, OBSERVATION_SCHEMA)], ordinal)
        union = part if union is None else union.unionByName(part)
    lat, lon = F.col("latitude"), F.col("longitude")
    sound = union.where(
        lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
        & F.col("`PM2.5`").isNotNull() & ~F.isnan("`PM2.5`") & F.col("timestamp").isNotNull())
    return keep_first(sound, ["station_id", "source", "timestamp"], ordinal)
