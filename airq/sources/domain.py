"""Air-quality tables derived from the benchmark's generic tables.

The benchmark brings no air-quality data. These mappings read its tables with
column pruning and turn them into observations, layers, roads and weather. Bad
rows are planted by rule so that every quality rule has something to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from airq.functions.met import wind_direction_from, wind_speed
from airq.functions.units import to_ug_m3
from airq.operators.daily import daily_mean
from airq.operators.features import build_training_table
from airq.operators.grid import Grid, assign_cell
from airq.operators.qc import observation_qc, survivors
from airq.session import materialize

STATION_GRID = Grid(77.0, 28.4, 0.05, 0.05, 9, 9, 77.45, 28.85)
ROAD_GRID = Grid.covering((0.0, 0.0, 39500.0, 39500.0), 1000.0)
WEATHER_GRID = Grid(77.0, 28.4, 0.1, 0.1, 5, 5, 77.4, 28.8)
MAJOR_ROADS = ["primary", "secondary"]
PIXEL_COLS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw observations with planted duplicates, gaps, bad values and bad units."""
    ev = table(spark, sf_dir, "events")
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("_nk"), F.col("n_name").alias("country"))
    eid, uid = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int") % 10
    copies = F.when(eid % 89 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    ev = ev.select("*", k.alias("_k"), F.explode(copies).alias("_copy"), (uid % 25).alias("_nk"))
    units = (F.when(eid % 107 == 0, F.lit(None).cast("string"))
             .when(F.col("_k") <= 3, "ug/m3").when(F.col("_k") <= 5, "μg/m³")
             .when(F.col("_k") == 6, " UG/m^3 ").when(F.col("_k") == 7, "mg/m3")
             .when(F.col("_k") == 8, "ng/m3").otherwise("ppm"))
    value = F.col("value") + F.col("_copy")
    value = (F.when(F.col("_k") == 7, value / 1000.0).when(F.col("_k") == 8, value * 1000.0)
             .otherwise(value))
    value = (F.when(eid % 103 == 0, F.lit(None).cast("double"))
             .when(eid % 97 == 0, -value - 1.0).otherwise(value))
    ts = F.when(eid % 109 != 0, F.col("ts").cast("timestamp"))
    return ev.join(nation, "_nk", "left").select(
        (eid * 2 + F.col("_copy")).alias("ordinal"),
        F.concat(F.lit("S"), uid.cast("string")).alias("station_id"),
        F.col("event_type").alias("source"), "country",
        F.when(eid % 101 == 0, F.lit(91.0)).otherwise(
            F.lit(28.4) + (uid * 7 % 401) / 1000.0).alias("latitude"),
        (F.lit(77.0) + (uid * 13 % 409) / 1000.0).alias("longitude"),
        ts.alias("timestamp"), value.alias("PM2.5"), units.alias("units"))


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    return obs.withColumn("pm25_ug_m3", to_ug_m3(F.col("`PM2.5`"), F.col("units")))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observation_qc(converted(spark, sf_dir), "ordinal")


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(checked(spark, sf_dir))


def daily(spark: SparkSession, sf_dir: str, min_observations: int = 1) -> DataFrame:
    return daily_mean(clean(spark, sf_dir), min_observations=min_observations)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position and mean value per station."""
    return clean(spark, sf_dir).groupBy("station_id").agg(
        F.min_by("latitude", "ordinal").alias("latitude"),
        F.min_by("longitude", "ordinal").alias("longitude"),
        F.avg("pm25_ug_m3").alias("pm25"), F.max("pm25_ug_m3").alias("peak"))


def cell_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gridded features per cell and day on the station grid."""
    li = table(spark, sf_dir, "lineitem")
    q, disc, tax, ln = (F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"),
                        F.col("l_linenumber"))
    per = li.groupBy(
        (F.col("l_suppkey") % 9).alias("cell_row"), (F.col("l_partkey") % 9).alias("cell_col"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("l_orderkey") % 30).cast("int"))
        .alias("date")).agg(
        F.avg(F.when(ln <= 2, disc * 10.0)).alias("AOD"), F.avg(q - 5.0).alias("temperature_c"),
        F.avg(tax * 1000.0 + 20.0).alias("relative_humidity_pct"),
        F.avg(disc * 100.0 - 5.0).alias("_u"), F.avg(tax * 100.0 - 4.0).alias("_v"),
        F.avg(F.when(ln <= 3, disc * q / 5.0)).alias("NDVI"),
        F.avg(F.col("l_extendedprice") / 1000.0).alias("night_lights"))
    return per.withColumns({
        "wind_speed_mps": wind_speed(F.col("_u"), F.col("_v")),
        "wind_direction_deg": wind_direction_from(F.col("_u"), F.col("_v"))}).drop("_u", "_v")


def cell_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a cell that do not change with the day."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(
        (F.col("l_suppkey") % 9).alias("cell_row"), (F.col("l_partkey") % 9).alias("cell_col")).agg(
        F.avg(F.col("l_quantity") * 10.0).alias("elevation_m"),
        (F.count(F.lit(1)) / 25.0).alias("road_density"))


def features_1km(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_days(spark, sf_dir).join(cell_static(spark, sf_dir), ["cell_row", "cell_col"])


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 38-column training table of station-days with their cell's features."""
    placed = assign_cell(daily(spark, sf_dir), STATION_GRID, "longitude", "latitude")
    return build_training_table(
        placed.join(features_1km(spark, sf_dir), ["cell_row", "cell_col", "date"], "left"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pixel per (row, col); the strip of rows grows with the data."""
    li = table(spark, sf_dir, "lineitem")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    picked = F.struct("l_quantity", "l_discount", "l_linenumber", "l_extendedprice", "l_shipdate")
    one = li.groupBy(F.floor(F.col("l_orderkey") / PIXEL_COLS).alias("row"),
                     (F.col("l_partkey") % PIXEL_COLS).alias("col")).agg(
        F.min_by(picked, key).alias("p"))
    return one.select(
        "row", "col", F.col("p.l_quantity").alias("value"),
        (F.col("p.l_linenumber") - 1).alias("qa"), F.col("p.l_discount").alias("discount"),
        F.col("p.l_extendedprice").alias("price"), F.to_date("p.l_shipdate").alias("obs_date"))


def written_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel table as a stored product, for work that reads it repeatedly."""
    return materialize(pixels(spark, sf_dir), "pixels")


def written_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training table as a stored product, for reports in several passes."""
    return materialize(training(spark, sf_dir), "training")


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather long table on a 5 x 5 field of positions."""
    li = table(spark, sf_dir, "lineitem")
    day = F.col("l_shipdate").cast("timestamp")
    hidden = F.dayofyear(day) % 50 == 0
    humid = F.when(F.col("l_orderkey") % 53 != 0, F.col("l_tax") * 1100.0 + 15.0)
    return li.select(
        (day + F.make_dt_interval(hours=F.col("l_linenumber") * 3)).alias("time"),
        (F.lit(28.4) + (F.col("l_suppkey") % 5) / 10.0).alias("latitude"),
        (F.lit(77.0) + (F.col("l_partkey") % 5) / 10.0).alias("longitude"),
        F.when(~hidden, F.lit(263.15) + F.col("l_quantity")).alias("temperature_k"),
        F.when(~hidden, F.lit(263.15) + F.col("l_quantity") - F.lit(273.15)).alias("temperature"),
        humid.alias("relative_humidity"),
        ((F.col("l_discount") * 100.0 - 5.0) * 10.0).alias("u_wind"),
        ((F.col("l_tax") * 100.0 - 4.0) * 10.0).alias("v_wind"),
        (F.col("l_suppkey") % 5).alias("row"), (F.col("l_partkey") % 5).alias("col"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-point road lines in metres with planted defects."""
    li = table(spark, sf_dir, "lineitem")
    ok = F.col("l_orderkey")
    x1 = (F.col("l_partkey") * 37 % 40000) + F.lit(0.5)
    y1 = (ok * 41 % 40000) + F.lit(0.25)
    x2 = x1 + (F.col("l_quantity") - 25.5) * 60.0
    y2 = y1 + (F.col("l_discount") * 100.0 - 5.5) * 150.0
    x3 = x2 + (F.col("l_tax") * 100.0 - 3.5) * 200.0
    y3 = y2 + 700.0

    def point(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    coords = (F.when(ok % 71 == 0, F.array(point(x1, y1)))
              .when(ok % 61 != 0, F.array(point(x1, y1), point(x2, y2), point(x3, y3))))
    highway = F.when(ok % 67 != 0, F.when(F.col("l_returnflag") == "A", "primary")
                     .when(F.col("l_returnflag") == "R", "secondary").otherwise("residential"))
    return li.select((ok * 8 + F.col("l_linenumber")).alias("road_id"),
                     highway.alias("highway"), coords.alias("coords"))


def location_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested pages, two locations each, built inside the row."""
    o = table(spark, sf_dir, "orders")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")

    def sensor(sid, name, when):
        return F.struct(sid.alias("id"), F.struct(name.alias("name"), F.lit("µg/m³").alias("units"))
                        .alias("parameter"), F.struct(when.alias("utc")).alias("datetimeLast"))

    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    later = F.date_format(F.date_add("o_orderdate", 3), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def location(lid, lat, lon, sensors):
        return F.struct(lid.alias("id"), F.concat(F.lit("L"), lid.cast("string")).alias("name"),
                        F.struct(lat.alias("latitude"), lon.alias("longitude")).alias("coordinates"),
                        F.struct((ck % 25).cast("string").alias("code"), F.lit("x").alias("name"))
                        .alias("country"), sensors.alias("sensors"))

    pm = F.lit("pm25")
    first = location(ck, (ck % 180).cast("double") - 85.0, (ck * 7 % 360).cast("double") - 180.0, F.array(
        sensor(ok * 10, pm, stamp), sensor(ok * 10 + 1, F.lit("no2"), later),
        sensor(ok * 10 + 2, F.when(ok % 2 == 0, pm).otherwise("o3"), later)))
    second = location(ck + 1_000_000_000, F.when(ok % 5 != 0, (ck % 80).cast("double")),
                      (ck % 170).cast("double"), F.array(
        sensor(ok * 10 + 3, F.when(ok % 3 == 0, pm).otherwise("so2"), stamp)))
    return o.select(F.col("o_orderkey").alias("page"), F.array(first, second).alias("results"))


def acquisition_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch log: one row per order, tile by customer, outcome by status."""
    o = table(spark, sf_dir, "orders")
    names = F.array(*[F.lit(s) for s in ("pm25", "aod", "weather", "ndvi", "dem", "osm", "viirs")])
    return o.select(
        F.element_at(names, (F.col("o_custkey") % 7 + 1).cast("int")).alias("source"),
        F.concat(F.lit("tile_"), (F.col("o_custkey") % 36).cast("string")).alias("tile_id"),
        F.when((F.col("o_custkey") % 7 == 4) | (F.col("o_custkey") % 7 == 2), "ok")
        .when(F.col("o_custkey") % 7 == 6, "failed")
        .when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("outcome"),
        F.date_format(F.date_add("o_orderdate", (F.col("o_custkey") % 7 * 20).cast("int")),
                      "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("fetched_at"),
        F.when(F.col("o_custkey") % 7 != 2, F.col("o_orderpriority")).alias("checksum"))
