"""Queries behind the read side, tiles and the streaming extension."""

from __future__ import annotations

from pyspark.sql import functions as F

from airq.functions import aqi
from airq.operators import serve as SV, source_status as S, tiles as TL, zones as Z
from airq.operators.daily import station_summary
from airq.operators.dedupe import latest
from airq.operators.grid import Grid, make_tiles
from airq.plans.registry import day, query, r6, rounded
from airq.plans.sql_parts import aqi_sql, category_sql, part
from airq.session import materialize, new_shared_path
from airq.sources import domain
from airq.streaming.daily import clean_stream, daily_stream, end_input, run_to_table

# Pixel space: the raster is 64 columns wide and as tall as the data.
PIXEL_GRID = Grid(0.0, 0.0, 1.0, 1.0, 2 ** 40, 64, 64.0, float(2 ** 40))

part("served", f"""
SELECT row, col, obs_date, qa, CASE WHEN qa <> 5 THEN value * 5.0::DOUBLE END AS pm25,
  CASE WHEN qa <> 5 THEN round_even({aqi_sql('(value * 5.0::DOUBLE)')}, 0) END AS aqi,
  CASE WHEN qa < 2 THEN discount * 10.0::DOUBLE END AS aod FROM pixels
""", "pixels")
part("points", """
SELECT o_orderkey AS id, (o_orderkey // 64) + 0.5::DOUBLE AS y, (o_custkey % 70) + 0.25::DOUBLE AS x FROM orders
""")


def _served(spark, sf_dir):
    ok = F.col("qa") != 5
    px = domain.pixels(spark, sf_dir).withColumn("pm25", F.when(ok, F.col("value") * 5.0))
    return px.select("row", "col", "obs_date", "pm25",
                     aqi.round_aqi(aqi.pm25_to_aqi(F.col("pm25"))).cast("double").alias("aqi"),
                     F.when(F.col("qa") < 2, F.col("discount") * 10.0).alias("aod"))


def _points(spark, sf_dir):
    return domain.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.floor(F.col("o_orderkey") / 64) + 0.5).alias("y"),
        (F.col("o_custkey") % 70 + 0.25).alias("x"))


_CAT = """CASE WHEN CAST(aqi AS INT) BETWEEN 0 AND 50 THEN 'GOOD' WHEN CAST(aqi AS INT) BETWEEN 51 AND 100 THEN 'SATISFACTORY'
  WHEN CAST(aqi AS INT) BETWEEN 101 AND 200 THEN 'MODERATELY_POLLUTED' WHEN CAST(aqi AS INT) BETWEEN 201 AND 300 THEN 'POOR'
  WHEN CAST(aqi AS INT) BETWEEN 301 AND 400 THEN 'VERY_POOR' WHEN CAST(aqi AS INT) BETWEEN 401 AND 500 THEN 'SEVERE' END"""


@query("available_dates", sql="""
SELECT strftime(d, '%Y-%m-%d') AS date FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders INTERSECT SELECT DISTINCT CAST(l_shipdate AS DATE) FROM lineitem) x
""")
def available_dates(spark, sf_dir):
    a = domain.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    b = domain.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return SV.available_dates(a, b).select(day("date"))


@query("pm25_at_points", parts=["served", "points"], sql="""
SELECT id, ROUND(pm25, 2) AS pm25, CASE WHEN x >= 64 THEN 'outside' WHEN pm25 IS NULL THEN 'NoData' ELSE 'valid' END AS status
FROM points LEFT JOIN served ON row = floor(y) AND col = floor(x)
""")
def pm25_at_points(spark, sf_dir):
    return SV.pm25_at_points(_points(spark, sf_dir), _served(spark, sf_dir), PIXEL_GRID,
                             value="pm25").select("id", "pm25", "status")


@query("aqi_at_points", parts=["served", "points"], sql=f"""
SELECT id, CAST(aqi AS BIGINT) AS pm25_aqi, {_CAT} AS category,
  CASE WHEN x >= 64 THEN 'outside' WHEN aqi IS NULL THEN 'NoData' ELSE 'valid' END AS status
FROM points LEFT JOIN served ON row = floor(y) AND col = floor(x)
""")
def aqi_at_points(spark, sf_dir):
    return SV.aqi_at_points(_points(spark, sf_dir), _served(spark, sf_dir), PIXEL_GRID).select(
        "id", "pm25_aqi", "category", "status")


@query("location_profile", parts=["served", "points"], sql=f"""
WITH h AS (SELECT id, greatest(abs(i), abs(j)) AS ring, i * i + j * j AS d2, i, j, aod FROM points
  CROSS JOIN (SELECT i.range - 2 AS i, j.range - 2 AS j FROM range(5) i, range(5) j) o
  JOIN served ON row = floor(y) + i AND col = floor(x) + j WHERE x < 64 AND aod >= 0),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ring, d2, i, j) AS rn FROM h) z WHERE rn = 1)
SELECT p.id, ROUND(s.pm25, 2) AS pm25, CAST(s.aqi AS BIGINT) AS pm25_derived_aqi, {_CAT} AS aqi_category, ROUND(b.aod, 4) AS aod,
  CASE WHEN x >= 64 THEN 'OUTSIDE_RASTER' WHEN b.id IS NULL THEN 'NO_VALID_OBSERVATION' ELSE 'AVAILABLE' END AS aod_status,
  CASE WHEN b.ring > 0 THEN 'nearest_valid_pixel' ELSE 'exact_pixel' END AS aod_lookup,
  coalesce(CAST(round_even(sqrt(d2), 0) AS INT), 0) AS distance_pixels
FROM points p LEFT JOIN served s ON s.row = floor(y) AND s.col = floor(x) LEFT JOIN b ON b.id = p.id
""")
def location_profile(spark, sf_dir):
    layer = materialize(_served(spark, sf_dir), "served")
    return SV.location_profile(_points(spark, sf_dir), layer, PIXEL_GRID, "x", "y").select(
        "id", "pm25", "pm25_derived_aqi", "aqi_category", "aod", "aod_status", "aod_lookup", "distance_pixels")


@query("grid_summary", parts=["pixels"], sql="""
SELECT year(obs_date) AS year, max(row) - min(row) + 1 AS n_rows, max(col) - min(col) + 1 AS n_cols, min(col) * 250.0::DOUBLE AS "left",
  min(row) * 250.0::DOUBLE AS bottom, (max(col) + 1) * 250.0::DOUBLE AS "right", (max(row) + 1) * 250.0::DOUBLE AS top FROM pixels GROUP BY 1
""")
def grid_summary(spark, sf_dir):
    px = domain.pixels(spark, sf_dir).withColumn("year", F.year("obs_date").cast("bigint"))
    return SV.grid_summary(px, Grid(0.0, 0.0, 250.0, 250.0, 1, 1, 1.0, 1.0), "year")


@query("hotspots_per_year", parts=["served"], sql=f"""
WITH RECURSIVE hotc AS (SELECT year(obs_date) AS yr, row, col FROM (SELECT *, {category_sql('aqi')} AS cat FROM served) z WHERE cat IN ('VERY_POOR', 'SEVERE')),
cell AS (SELECT yr, row * 64 + col AS n, row, col FROM hotc),
edge AS (SELECT a.yr, a.n AS x, b.n AS y FROM cell a JOIN cell b ON a.yr = b.yr AND b.row = a.row AND b.col = a.col + 1
  UNION ALL SELECT a.yr, b.n, a.n FROM cell a JOIN cell b ON a.yr = b.yr AND b.row = a.row AND b.col = a.col + 1
  UNION ALL SELECT a.yr, a.n, b.n FROM cell a JOIN cell b ON a.yr = b.yr AND b.row = a.row + 1 AND b.col = a.col
  UNION ALL SELECT a.yr, b.n, a.n FROM cell a JOIN cell b ON a.yr = b.yr AND b.row = a.row + 1 AND b.col = a.col),
lab(yr, n, l) USING KEY (yr, n) AS (SELECT yr, n, n FROM cell UNION
  SELECT e.yr, e.y, min(lab.l) FROM lab JOIN edge e ON e.yr = lab.yr AND e.x = lab.n JOIN recurring.lab r ON r.yr = e.yr AND r.n = e.y WHERE lab.l < r.l GROUP BY 1, 2)
SELECT CAST(yr AS BIGINT) AS year, row_number() OVER (PARTITION BY yr ORDER BY l) AS hotspot_id, count(*) AS n_cells, count(*) * 0.25::DOUBLE AS area_km2 FROM lab GROUP BY yr, l
""")
def hotspots_per_year(spark, sf_dir):
    """Zones of every year at once; the year is part of every join key."""
    cells = _served(spark, sf_dir).withColumns({
        "year": F.year("obs_date").cast("bigint"), "aqi_category": aqi.aqi_category(F.col("aqi"))})
    hot = Z.hotspot_mask(cells).select("year", "row", "col")
    zones = Z.hotspot_zones(Z.label_zones(hot, domain.PIXEL_COLS, by=["year"]), 0.25, by=["year"])
    return zones.select("year", "hotspot_id", "n_cells", "area_km2")


@query("station_overview", parts=["clean", "daily"], sql="""
SELECT c.station_id, count(*) AS observation_count, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last_timestamp,
  ROUND(any_value(latest), 6) AS latest_pm25 FROM clean c LEFT JOIN (SELECT station_id, arg_max(pm25_daily, date) AS latest FROM daily
  WHERE observation_count >= 3 GROUP BY 1) d ON d.station_id = c.station_id GROUP BY 1
""")
def station_overview(spark, sf_dir):
    last = latest(domain.daily(spark, sf_dir, 3), ["station_id"], "date", ["pm25_daily"]).withColumnRenamed(
        "pm25_daily", "latest_pm25")
    out = SV.station_overview(station_summary(domain.clean(spark, sf_dir)), last)
    return out.select("station_id", "observation_count",
                      F.date_format("last_timestamp", "yyyy-MM-dd HH:mm:ss").alias("last_timestamp"),
                      r6("latest_pm25").alias("latest_pm25"))


# ----------------------------------------------------------- areas and scopes

part("boxes", """
SELECT c_custkey AS id, w AS west, s AS south, w + c_custkey % 23 / 100.0::DOUBLE - 0.02::DOUBLE AS east, s + c_custkey % 19 / 100.0::DOUBLE - 0.01::DOUBLE AS north
FROM (SELECT *, 76.95::DOUBLE + c_custkey % 37 / 100.0::DOUBLE AS w, 28.38::DOUBLE + c_custkey % 41 / 100.0::DOUBLE AS s FROM customer) x
""")


def _boxes(spark, sf_dir):
    k = F.col("c_custkey")
    base = domain.table(spark, sf_dir, "customer").select(
        k.alias("id"), (F.lit(76.95) + k % 37 / 100.0).alias("west"), (F.lit(28.38) + k % 41 / 100.0).alias("south"))
    i = F.col("id")
    return base.withColumns({"east": F.col("west") + i % 23 / 100.0 - 0.02,
                             "north": F.col("south") + i % 19 / 100.0 - 0.01})


_INSIDE = ("west >= 77.0::DOUBLE - 1e-6 AND south >= 28.4::DOUBLE - 1e-6 AND east <= 77.4::DOUBLE + 1e-6 "
           "AND north <= 28.8::DOUBLE + 1e-6")


@query("scope_gate", parts=["boxes"], sql=f"""
SELECT id, CASE WHEN {_INSIDE} THEN 'available' ELSE 'unavailable_for_aoi' END AS scope_status, {_INSIDE} AS can_predict FROM boxes
""")
def scope_gate(spark, sf_dir):
    return S.scope_gate(_boxes(spark, sf_dir)).select("id", "scope_status", "can_predict")


@query("cells_in_boxes", parts=["boxes", "stations"], sql=f"""
SELECT id, ROUND(longitude, 6) AS longitude, ROUND(latitude, 6) AS latitude, ROUND(peak, 2) AS peak, NULL::VARCHAR AS refused FROM boxes JOIN stations
  ON longitude BETWEEN west AND east AND latitude BETWEEN south AND north WHERE west < east AND south < north AND {_INSIDE}
UNION ALL SELECT id, NULL, NULL, NULL, CASE WHEN west >= east OR south >= north THEN 'west<east and south<north required'
  ELSE 'no validated model for this area' END FROM boxes WHERE west >= east OR south >= north OR NOT ({_INSIDE})
""")
def cells_in_boxes(spark, sf_dir):
    """All boxes asked for against all stations in one bucketed join."""
    return SV.cells_in_boxes(_boxes(spark, sf_dir), domain.stations(spark, sf_dir), "id", "peak", 0.05)


@query("resolved_areas", sql="""
WITH r AS (SELECT c_custkey AS id, c_custkey % 4 AS k, c_custkey % 90 AS b FROM customer)
SELECT id, CASE WHEN k = 0 THEN 'bbox' ELSE 'region' END AS mode, CASE k WHEN 0 THEN 'Custom AOI' WHEN 1 THEN 'pune' WHEN 2 THEN 'global' ELSE 'delhi' END AS aoi,
  CASE k WHEN 0 THEN b::DOUBLE WHEN 1 THEN 73.7::DOUBLE WHEN 2 THEN -180.0::DOUBLE ELSE 77.0::DOUBLE END AS west,
  CASE k WHEN 0 THEN b + 2.5::DOUBLE WHEN 1 THEN 74.1::DOUBLE WHEN 2 THEN 180.0::DOUBLE ELSE 77.4::DOUBLE END AS east,
  CASE k WHEN 0 THEN 32600 + CAST(floor((b + 1.25 + 180) / 6) + 1 AS INT) WHEN 1 THEN 32643 WHEN 3 THEN 32643 END AS metric_epsg,
  ROUND(CASE k WHEN 0 THEN radians(2.5::DOUBLE) * (sin(radians(b / 2.0::DOUBLE + 1.0::DOUBLE)) - sin(radians(b / 2.0::DOUBLE)))
    WHEN 1 THEN radians(74.1::DOUBLE - 73.7::DOUBLE) * (sin(radians(18.7::DOUBLE)) - sin(radians(18.4::DOUBLE)))
    WHEN 2 THEN radians(360.0::DOUBLE) * 2 ELSE radians(77.4::DOUBLE - 77.0::DOUBLE) * (sin(radians(28.8::DOUBLE)) - sin(radians(28.4::DOUBLE))) END
    * 6371.0072::DOUBLE * 6371.0072::DOUBLE, 3) AS area_km2 FROM r
""")
def resolved_areas(spark, sf_dir):
    """Own box, region name or default, with area and metric system."""
    k, b = F.col("c_custkey") % 4, (F.col("c_custkey") % 90).cast("double")
    own = k == 0
    requests = domain.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.when(k == 1, "pune").when(k == 2, "global").alias("region"),
        F.when(own, b).alias("west"), F.when(own, b / 2.0).alias("south"),
        F.when(own, b + 2.5).alias("east"), F.when(own, b / 2.0 + 1.0).alias("north"))
    out = S.resolve_aoi(requests)
    return out.select("id", "mode", "aoi", "west", "east", "metric_epsg", F.round("area_km2", 3).alias("area_km2"))


@query("output_metadata", parts=["boxes"], sql=f"""
WITH d AS (SELECT count(*) FILTER (CAST(o_orderdate AS DATE) = DATE '1997-06-02') AS p FROM orders),
a AS (SELECT count(*) FILTER (CAST(l_shipdate AS DATE) = DATE '1997-06-02') AS a FROM lineitem)
SELECT id, ({_INSIDE}) AND p > 0 AS has_pm25, ({_INSIDE}) AND a > 0 AS has_aqi,
  CASE WHEN NOT ({_INSIDE}) THEN 'no validated model for this area' WHEN p = 0 THEN 'no output for this day' END AS reason FROM boxes, d, a
""")
def output_metadata(spark, sf_dir):
    pm = domain.table(spark, sf_dir, "orders").select(F.lit("pm25").alias("product"), F.to_date("o_orderdate").alias("date"))
    ix = domain.table(spark, sf_dir, "lineitem").select(F.lit("aqi").alias("product"), F.to_date("l_shipdate").alias("date"))
    out = SV.output_metadata(_boxes(spark, sf_dir), pm.unionByName(ix), "1997-06-02")
    return out.select("id", "has_pm25", "has_aqi", "reason")


@query("tagged_predictions", parts=["stations"], sql="""
SELECT station_id, ROUND(pm25, 8) AS pm25, 'delhi' AS scope_id, 'available' AS scope_status FROM stations
WHERE longitude BETWEEN 77.0::DOUBLE AND 77.4::DOUBLE AND latitude BETWEEN 28.4::DOUBLE AND 28.8::DOUBLE
""")
def tagged_predictions(spark, sf_dir):
    from airq.functions.geo import SCOPES, in_bbox
    rows = domain.stations(spark, sf_dir).where(in_bbox(F.col("longitude"), F.col("latitude"), SCOPES["delhi"]))
    return S.scope_tag(rows, "delhi", "available").select(
        "station_id", r6("pm25", 8).alias("pm25"), "model_scope.scope_id", "model_scope.scope_status")


# ------------------------------------------------------------ tiles, streaming


def tile_task(tile: dict) -> str:
    """Example tile function: refuses tiles without stations."""
    if not tile["customers"]:
        raise ValueError("empty tile")
    return f"{int(tile['customers'])} customers"


@query("per_tile_results", sql="""
WITH t AS (SELECT 'tile_' || lpad(CAST(ix.range AS VARCHAR), 3, '0') || '_' || lpad(CAST(iy.range AS VARCHAR), 3, '0') AS tile_id, ix.range AS i, iy.range AS j FROM range(36) ix, range(18) iy),
k AS (SELECT c_custkey % 36 AS i, c_custkey % 17 AS j, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT tile_id, CASE WHEN n IS NULL THEN 'failed' ELSE 'completed' END AS status, n || ' customers' AS result,
  CASE WHEN n IS NULL THEN 'ValueError: empty tile' END AS error FROM t LEFT JOIN k USING (i, j)
""")
def per_tile_results(spark, sf_dir):
    k = F.col("c_custkey")
    counts = domain.table(spark, sf_dir, "customer").groupBy(
        F.format_string("tile_%03d_%03d", k % 36, k % 17).alias("tile_id")).agg(F.count(F.lit(1)).alias("customers"))
    tiles = make_tiles(spark, (-180.0, -90.0, 180.0, 90.0)).join(counts, "tile_id", "left").fillna({"customers": 0})
    return TL.per_tile(tiles, tile_task).drop("seconds")


@query("streamed_daily_means", sql="""
WITH s AS (SELECT DISTINCT ON (user_id, ts) * FROM events ORDER BY user_id, ts, event_id)
SELECT 'S' || user_id AS station_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, ROUND(avg(value), 6) AS pm25_daily, count(*) AS observation_count
FROM s GROUP BY 1, 2
""")
def streamed_daily_means(spark, sf_dir):
    """All events arrive as files, with repeated rows of other values; every day comes out, as in batch."""
    obs = domain.table(spark, sf_dir, "events").select(
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("station_id"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.lit(28.5).alias("latitude"),
        F.lit(77.1).alias("longitude"), F.col("value").alias("PM2.5"), F.lit("ug/m3").alias("units"), F.col("event_id").alias("ordinal"))
    folder = new_shared_path(spark, "arrivals")
    copies = obs.where(F.col("ordinal") % 7 == 0).withColumns({"PM2.5": F.col("`PM2.5`") + 1.0, "ordinal": F.col("ordinal") + 10 ** 12})
    copies.unionByName(obs).write.parquet(folder)
    end_input(spark, folder, obs)
    stream = spark.readStream.schema(obs.schema).parquet(folder)
    out = run_to_table(spark, daily_stream(clean_stream(stream, ordinal="ordinal")), "daily-stream")
    return rounded(out, "pm25_daily").withColumn("date", F.date_format("date", "yyyy-MM-dd"))


# ------------------------------------------------------------------- one answer


@query("station_detail", parts=["daily"], sql="""
WITH most AS (SELECT station_id FROM daily GROUP BY 1 ORDER BY count(*) DESC, station_id LIMIT 1)
SELECT strftime(date, '%Y-%m-%d') AS date, ROUND(pm25_daily, 6) AS pm25_daily, observation_count FROM daily JOIN most USING (station_id)
""")
def station_detail(spark, sf_dir):
    """Daily series of the station with the most days."""
    daily = materialize(domain.daily(spark, sf_dir), "daily")
    top = daily.groupBy("station_id").count().orderBy(F.desc("count"), "station_id").first()
    return rounded(SV.station_series(daily, top["station_id"] if top else ""), "pm25_daily").withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("coverage_of_scopes", parts=["log"], sql="""
WITH r AS (SELECT source, CASE WHEN count(*) FILTER (outcome = 'ok') > 0 THEN 'present' ELSE 'missing' END AS status, CASE WHEN source = 'pm25' THEN 'delhi' ELSE 'india' END AS built
  FROM log GROUP BY source)
SELECT 'india' AS asked, source, status, built AS built_for_scope FROM r WHERE built = 'india'
UNION ALL SELECT 'global', NULL, 'not_run', built FROM (SELECT DISTINCT built FROM r) x
""")
def coverage_of_scopes(spark, sf_dir):
    """The coverage report for a scope that it was built for and for one that it was not."""
    log = domain.acquisition_log(spark, sf_dir)
    report = log.groupBy("source").agg(F.when(F.count(F.when(F.col("outcome") == "ok", 1)) > 0, "present").otherwise("missing").alias("status")).withColumn(
        "built_for_scope", F.when(F.col("source") == "pm25", "delhi").otherwise("india"))
    answers = [SV.coverage_for_scope(report, scope).select(F.lit(scope).alias("asked"), "source", "status", "built_for_scope") for scope in ("india", "global")]
    return answers[0].unionByName(answers[1])
