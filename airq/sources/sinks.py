"""Writers and the artifact manifest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  sort_within: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet with optional partition folders and row order inside files."""
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def json_lines(df: DataFrame, column: str = "value") -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias(column))


def write_json_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row."""
    json_lines(df).write.mode(mode).text(path)


def _json_number(x: Column) -> Column:
    """A double as JSON text without an exponent where it is 1e7 or more, with the digits that it needs."""
    text = x.cast("string")
    # A double of 1e7 or more needs ten decimals at most.
    digits = F.regexp_replace(text.cast("decimal(38,10)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when((F.abs(x) >= 1e7) & (F.abs(x) < 1e21), digits).otherwise(text)


def geojson_features(zones: DataFrame, west: Column, south: Column, east: Column,
                     north: Column, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per zone with its bounding rectangle as geometry; NULL properties are left out."""
    corner = [(west, south), (east, south), (east, north), (west, north), (west, south)]
    number = lambda x: F.coalesce(_json_number(x.cast("double")), F.lit("null"))
    ring = F.concat_ws(",", *[F.concat(F.lit("["), number(x), F.lit(","), number(y), F.lit("]")) for x, y in corner])

    def member(name: str) -> Column:
        if zones.schema[name].dataType.typeName() == "double":
            return F.concat(F.lit(json.dumps(name) + ":"), _json_number(F.col(name)))
        alone = F.to_json(F.struct(name))
        return F.when(F.col(name).isNotNull(), F.substring(alone, F.lit(2), F.length(alone) - 2))

    return zones.select(F.concat(
        F.lit('{"type":"Feature","properties":{'), F.concat_ws(",", *map(member, properties)),
        F.lit('},"geometry":{"type":"Polygon","coordinates":[['), ring, F.lit("]]}}")).alias("value"))


def write_geojson_zones(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One feature per line (GeoJSON text sequence); no feature, no line."""
    features.write.mode(mode).text(path)


def artifact_manifest(spark: SparkSession, path: str, source: str,
                      glob: str = "*") -> DataFrame:
    """Path, source, size, time and SHA-256 of every file below a folder."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", True).load(path))
    return files.select("path", F.lit(source).alias("source"), F.col("length").alias("size_bytes"),
                        F.col("modificationTime").alias("modified"),
                        F.sha2("content", 256).alias("sha256"))


def artifact_files(spark: SparkSession, path: str, source: str, glob: str = "*") -> DataFrame:
    """File names, times and sizes only; contents are not read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", True).load(path))
    return files.select(F.lit(source).alias("source"), "path",
                        F.col("modificationTime").alias("modified"), "length")


def validate_manifest(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, status): ok, changed, missing or unexpected."""
    want = expected.select("path", F.col("sha256").alias("_want"))
    have = actual.select("path", F.col("sha256").alias("_have"))
    return want.join(have, "path", "full").select(
        "path", F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unexpected")
        .when(F.col("_have") == F.col("_want"), "ok").otherwise("changed").alias("status"))
