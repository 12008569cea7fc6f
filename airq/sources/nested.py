"""Flattening the nested pages of an observation provider."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airq.functions.geo import in_bbox
from airq.operators.dedupe import keep_first

SENSOR_DAY_SCHEMA = (
    "results array<struct<value:double,unit:string,period:struct<"
    "datetimeFrom:struct<utc:string>,datetimeTo:struct<utc:string>>>>")


def flatten_locations(pages: DataFrame, bounds: tuple[float, float, float, float],
                      order: str) -> DataFrame:
    """One row per location inside the box with its newest PM2.5 sensor.

    ``pages`` has ``results`` and a page number ``order``. Of repeated
    locations the first occurrence counts; a location whose first occurrence
    has no such sensor gives no row.
    """
    located = pages.select(F.col(order), F.posexplode("results").alias("pos", "loc")).where(
        in_bbox(F.col("loc.coordinates.longitude"), F.col("loc.coordinates.latitude"), bounds))
    # Reduce the sensors inside the row before anything is shuffled.
    pm25 = F.filter("loc.sensors", lambda s: s["parameter"]["name"] == "pm25")
    newest = F.aggregate(
        F.transform(pm25, lambda s: F.struct(
            F.coalesce(s["datetimeLast"]["utc"], F.lit("")).alias("last"), s["id"].alias("id"))),
        F.lit(None).cast("struct<last:string,id:bigint>"),
        lambda best, s: F.when(best.isNull() | (s["last"] > best["last"]), s).otherwise(best))
    flat = located.select(
        F.struct(order, "pos").alias("_seq"), F.col("loc.id").alias("location_id"),
        F.coalesce("loc.name", F.lit("")).alias("name"),
        F.col("loc.coordinates.latitude").alias("latitude"),
        F.col("loc.coordinates.longitude").alias("longitude"),
        F.coalesce("loc.country.code", F.lit("")).alias("country"),
        newest.getField("id").alias("sensor_id"))
    return keep_first(flat, ["location_id"], "_seq").drop("_seq").where(
        F.col("sensor_id").isNotNull())


def flatten_sensor_days(pages: DataFrame) -> DataFrame:
    """Day rows of sensors as observations; missing and negative values are dropped.

    ``pages`` has the station columns (location_id, latitude, longitude,
    country) and ``results``.
    """
    rows = pages.select("location_id", "latitude", "longitude", "country",
                        F.explode("results").alias("d"))
    when = F.coalesce("d.period.datetimeFrom.utc", "d.period.datetimeTo.utc")
    return rows.where((F.col("d.value") >= 0) & when.isNotNull()).select(
        F.col("location_id").cast("string").alias("station_id"), F.lit("openaq").alias("source"),
        "country", "latitude", "longitude", F.try_to_timestamp(when).alias("timestamp"),
        F.col("d.value").alias("PM2.5"),
        F.when(F.coalesce("d.unit", F.lit("")) == "", "ug/m3").otherwise(F.col("d.unit")).alias("units"),
        F.lit("openaq_reported").alias("quality_flag"))
