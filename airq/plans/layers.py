"""Queries on grids, rasters, time joins, weather and roads."""

from __future__ import annotations

from pyspark.sql import functions as F

from airq.functions import geo, masks
from airq.functions.units import kelvin_to_celsius
from airq.operators import asof, features as FT, grid as G, raster as R, roads as RD, weather as WX
from airq.operators.grid import Grid
from airq.plans.registry import day, query, r6, rounded
from airq.session import materialize
from airq.sources import domain
from airq.sources.readers import lines_in_box

# ---------------------------------------------------------------- coordinates


@query("utm_round_trip", parts=["stations"], sql="""
WITH c AS (SELECT 1.0::DOUBLE / 298.257223563::DOUBLE AS f),
n AS (SELECT f / (2.0::DOUBLE - f) AS n FROM c),
k AS (SELECT n, 6378137.0::DOUBLE / (1 + n) * (1 + n*n/4 + n*n*n*n/64) * 0.9996::DOUBLE AS ka,
  2.0::DOUBLE * sqrt(n) / (1 + n) AS e, n/2 - 2*n*n/3 + 5*n*n*n/16 AS a1, 13*n*n/48 - 3*n*n*n/5 AS a2,
  61*n*n*n/240 AS a3 FROM n),
s AS (SELECT station_id, longitude, latitude, radians(longitude - 75.0::DOUBLE) AS dl,
  sinh(atanh(sin(radians(latitude))) - e * atanh(e * sin(radians(latitude)))) AS t, k.* FROM stations, k),
p AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t*t)) AS eta FROM s)
SELECT station_id, 32643::INT AS epsg,
  ROUND(500000 + ka * (eta + a1*cos(2*xi)*sinh(2*eta) + a2*cos(4*xi)*sinh(4*eta) + a3*cos(6*xi)*sinh(6*eta)), 3) AS x,
  ROUND(ka * (xi + a1*sin(2*xi)*cosh(2*eta) + a2*sin(4*xi)*cosh(4*eta) + a3*sin(6*xi)*cosh(6*eta)), 3) AS y,
  ROUND(longitude, 6) AS lon_back, ROUND(latitude, 6) AS lat_back
FROM p
""")
def utm_round_trip(spark, sf_dir):
    pts = domain.stations(spark, sf_dir).withColumn(
        "epsg", geo.utm_epsg(F.col("longitude"), F.col("latitude")))
    metric = geo.with_utm(pts, "longitude", "latitude", F.col("epsg"))
    back = geo.with_lonlat(metric, "x", "y", F.col("epsg"), "lon_back", "lat_back")
    return back.select("station_id", "epsg", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"),
                       r6("lon_back").alias("lon_back"), r6("lat_back").alias("lat_back"))


@query("tile_names", sql="""
SELECT 'tile_' || lpad(CAST(least(floor((lon + 180) / 10), 35)::INT AS VARCHAR), 3, '0') || '_'
     || lpad(CAST(least(floor((lat + 90) / 10), 17)::INT AS VARCHAR), 3, '0') AS tile_id,
  count(*) AS customers, count(DISTINCT srtm) AS elevation_tiles, min(srtm) AS first_elevation_tile
FROM (SELECT *, CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(floor(lat))::INT AS VARCHAR), 2, '0')
   || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(floor(lon))::INT AS VARCHAR), 3, '0') AS srtm
  FROM (SELECT (c_custkey * 37 % 3601) / 10.0::DOUBLE - 180.0::DOUBLE AS lon,
               (c_custkey * 17 % 1801) / 10.0::DOUBLE - 90.0::DOUBLE AS lat FROM customer) a) b
GROUP BY 1
""")
def tile_names(spark, sf_dir):
    k = F.col("c_custkey")
    pts = domain.table(spark, sf_dir, "customer").select(
        ((k * 37 % 3601) / 10.0 - 180.0).alias("lon"), ((k * 17 % 1801) / 10.0 - 90.0).alias("lat"))
    named = pts.select(geo.tile_id(F.col("lon"), F.col("lat")).alias("tile_id"),
                       geo.srtm_tile_name(F.col("lon"), F.col("lat")).alias("srtm"))
    return named.groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("customers"), F.countDistinct("srtm").alias("elevation_tiles"),
        F.min("srtm").alias("first_elevation_tile"))


@query("stations_in_polygon", parts=["stations"], sql="""
SELECT station_id,
  longitude > 77.05::DOUBLE AND longitude < 77.3::DOUBLE AND latitude > 28.45::DOUBLE AND latitude < 28.7::DOUBLE AS in_rectangle,
  latitude > 28.4::DOUBLE AND latitude < 28.4::DOUBLE + (longitude - 77.0::DOUBLE)
    AND longitude < 77.4::DOUBLE AS in_triangle
FROM stations
""")
def stations_in_polygon(spark, sf_dir):
    x, y = F.col("longitude"), F.col("latitude")
    rectangle = [(77.05, 28.45), (77.3, 28.45), (77.3, 28.7), (77.05, 28.7)]
    triangle = [(77.0, 28.4), (77.4, 28.4), (77.4, 28.8)]
    return domain.stations(spark, sf_dir).select(
        "station_id", geo.point_in_polygon(x, y, rectangle).alias("in_rectangle"),
        geo.point_in_polygon(x, y, triangle).alias("in_triangle"))


# ----------------------------------------------------------------------- grids


@query("stations_per_cell", parts=["stations"], sql="""
WITH c AS (SELECT r.range AS row, c.range AS col FROM range(9) r, range(9) c),
s AS (SELECT CAST(floor((latitude - 28.4::DOUBLE) / 0.05::DOUBLE) AS BIGINT) AS row,
   CAST(floor((longitude - 77.0::DOUBLE) / 0.05::DOUBLE) AS BIGINT) AS col, pm25 FROM stations)
SELECT lpad(CAST(col AS VARCHAR), 3, '0') || '_' || lpad(CAST(row AS VARCHAR), 3, '0') AS grid_id,
  ROUND(77.0::DOUBLE + col * 0.05::DOUBLE + 0.025::DOUBLE, 6) AS cx, count(pm25) AS stations, ROUND(avg(pm25), 8) AS pm25
FROM c LEFT JOIN s USING (row, col) GROUP BY 1, 2
""")
def stations_per_cell(spark, sf_dir):
    grid = domain.STATION_GRID
    placed = G.assign_cell(domain.stations(spark, sf_dir), grid, "longitude", "latitude").groupBy(
        F.col("cell_row").alias("row"), F.col("cell_col").alias("col")).agg(
        F.count("pm25").alias("stations"), F.avg("pm25").alias("pm25"))
    return G.make_grid(spark, grid).join(placed, ["row", "col"], "left").select(
        "grid_id", r6("cx").alias("cx"), F.coalesce("stations", F.lit(0)).alias("stations"),
        r6("pm25", 8).alias("pm25"))


@query("parent_cells", parts=["pixels"], sql="""
SELECT row // 2 AS parent_row, col // 2 AS parent_col, count(*) AS children, ROUND(avg(value), 6) AS mean_value
FROM pixels GROUP BY 1, 2
""")
def parent_cells(spark, sf_dir):
    return G.assign_parent(domain.pixels(spark, sf_dir), 2).groupBy("parent_row", "parent_col").agg(
        F.count(F.lit(1)).alias("children"), r6(F.avg("value")).alias("mean_value"))


@query("cell_day_scaffold", parts=["features_1km"], sql="""
WITH c AS (SELECT r.range AS row, c.range AS col FROM range(9) r, range(9) c),
d AS (SELECT CAST(unnest(range(DATE '2023-12-31', DATE '2024-02-03', INTERVAL 1 DAY)) AS DATE) AS date)
SELECT strftime(d.date, '%Y-%m-%d') AS date, count(*) AS cells, count(f.temperature_c) AS with_weather,
  count(f."AOD") AS with_aod, ROUND(avg(f."NDVI"), 6) AS mean_ndvi
FROM c CROSS JOIN d LEFT JOIN features_1km f ON f.cell_row = c.row AND f.cell_col = c.col AND f.date = d.date
GROUP BY 1
""")
def cell_day_scaffold(spark, sf_dir):
    """Every cell on every day, with static and dated layers where they exist."""
    static = domain.cell_static(spark, sf_dir).withColumnsRenamed({"cell_row": "row", "cell_col": "col"})
    dated = domain.cell_days(spark, sf_dir).withColumnsRenamed({"cell_row": "row", "cell_col": "col"})
    cells = G.make_grid(spark, domain.STATION_GRID).select("row", "col", "grid_id")
    out = FT.master_features(cells, "2023-12-31", "2024-02-02", static, dated)
    return out.groupBy(day("date")).agg(
        F.count(F.lit(1)).alias("cells"), F.count("temperature_c").alias("with_weather"),
        F.count("AOD").alias("with_aod"), r6(F.avg("NDVI")).alias("mean_ndvi"))


@query("cells_on_observed_days", parts=["daily"], sql="""
WITH c AS (SELECT r.range AS row, c.range AS col FROM range(9) r, range(9) c),
d AS (SELECT DISTINCT date FROM daily),
o AS (SELECT date, CAST(floor((latitude - 28.4::DOUBLE) / 0.05::DOUBLE) AS BIGINT) AS row,
   CAST(floor((longitude - 77.0::DOUBLE) / 0.05::DOUBLE) AS BIGINT) AS col, count(*) AS n, sum(pm25_daily) AS s
   FROM daily GROUP BY 1, 2, 3)
SELECT c.row, c.col, count(*) AS days, count(o.n) AS observed_days, ROUND(sum(s) / sum(n), 6) AS mean_pm25
FROM c CROSS JOIN d LEFT JOIN o ON o.row = c.row AND o.col = c.col AND o.date = d.date GROUP BY 1, 2
""")
def cells_on_observed_days(spark, sf_dir):
    days = domain.daily(spark, sf_dir)
    seen = G.assign_cell(days, domain.STATION_GRID, "longitude", "latitude").groupBy(
        F.col("cell_row").alias("row"), F.col("cell_col").alias("col"), "date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pm25_daily").alias("s"))
    cells = G.make_grid(spark, domain.STATION_GRID).select("row", "col")
    return G.grid_dates_of(cells, days).join(seen, ["row", "col", "date"], "left").groupBy(
        "row", "col").agg(F.count(F.lit(1)).alias("days"), F.count("n").alias("observed_days"),
                          r6(F.sum("s") / F.sum("n")).alias("mean_pm25"))


@query("static_layer_on_cells", parts=["cell_static"], sql="""
WITH c AS (SELECT r.range AS row, c.range AS col FROM range(45) r, range(45) c),
p AS (SELECT row, col, CAST(floor((28.4::DOUBLE + row * 0.01::DOUBLE + 0.005::DOUBLE - 28.4::DOUBLE) / 0.05::DOUBLE) AS BIGINT) AS cell_row,
  CAST(floor((77.0::DOUBLE + col * 0.01::DOUBLE + 0.005::DOUBLE - 77.0::DOUBLE) / 0.05::DOUBLE) AS BIGINT) AS cell_col FROM c)
SELECT row, col, ROUND(road_density, 6) AS road_density FROM p LEFT JOIN cell_static USING (cell_row, cell_col)
""")
def static_layer_on_cells(spark, sf_dir):
    """Coarse road density read at the centroids of a finer grid."""
    fine = Grid(77.0, 28.4, 0.01, 0.01, 45, 45, 77.45, 28.85)
    layer = domain.cell_static(spark, sf_dir).withColumnsRenamed({"cell_row": "row", "cell_col": "col"})
    out = G.join_static_layer(G.make_grid(spark, fine), layer, domain.STATION_GRID, "road_density")
    return out.select("row", "col", r6("road_density").alias("road_density"))


@query("tiles_with_customers", sql="""
WITH t AS (SELECT ix.range AS ix, iy.range AS iy, greatest(-180.0::DOUBLE, -180.0::DOUBLE + ix.range * 10.0::DOUBLE - 1.0::DOUBLE) AS west,
   greatest(-90.0::DOUBLE, -90.0::DOUBLE + iy.range * 10.0::DOUBLE - 1.0::DOUBLE) AS south,
   least(180.0::DOUBLE, -180.0::DOUBLE + ix.range * 10.0::DOUBLE + 11.0::DOUBLE) AS east,
   least(90.0::DOUBLE, -90.0::DOUBLE + iy.range * 10.0::DOUBLE + 11.0::DOUBLE) AS north
  FROM range(36) ix, range(18) iy),
k AS (SELECT CAST(least(floor(((c_custkey * 37 % 3601) / 10.0::DOUBLE) / 10), 35) AS BIGINT) AS ix,
  CAST(least(floor(((c_custkey * 17 % 1801) / 10.0::DOUBLE) / 10), 17) AS BIGINT) AS iy, c_acctbal FROM customer)
SELECT 'tile_' || lpad(CAST(ix AS VARCHAR), 3, '0') || '_' || lpad(CAST(iy AS VARCHAR), 3, '0') AS tile_id,
  west, south, east, north, count(c_acctbal) AS customers
FROM t LEFT JOIN k USING (ix, iy) WHERE west < 60 AND east > -20 AND south < 40 AND north > -10
GROUP BY ix, iy, west, south, east, north
""")
def tiles_with_customers(spark, sf_dir):
    """World tiles with overlap that meet a box, with the customers in their core."""
    k = F.col("c_custkey")
    counts = domain.table(spark, sf_dir, "customer").select(
        geo.tile_id((k * 37 % 3601) / 10.0 - 180.0, (k * 17 % 1801) / 10.0 - 90.0).alias("tile_id")
    ).groupBy("tile_id").agg(F.count(F.lit(1)).alias("customers"))
    tiles = G.tiles_intersecting(G.make_tiles(spark, (-180.0, -90.0, 180.0, 90.0), 10.0, 1.0),
                                 (-20.0, -10.0, 60.0, 40.0))
    return tiles.join(counts, "tile_id", "left").fillna({"customers": 0})


# ------------------------------------------------------------------ time joins

_COMPOSITES = """
comp AS (SELECT DISTINCT CASE WHEN month(o_orderdate) <> 7 THEN
    DATE '2000-02-18' + CAST(floor((CAST(o_orderdate AS DATE) - DATE '2000-02-18') / 16.0::DOUBLE) * 16 AS INT) END AS c FROM orders),
ships AS (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1)
"""


def _composites(spark, sf_dir):
    """Distinct 16-day starts of order dates; those of July are unknown, which leaves a gap."""
    start = F.when(F.month("o_orderdate") != 7, asof.composite_start(F.to_date("o_orderdate")))
    return domain.table(spark, sf_dir, "orders").select(start.alias("composite")).distinct()


def _ships(spark, sf_dir):
    return domain.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"))


def _matched(df, matched):
    """Rows and mean offset per target day."""
    return df.groupBy(day("date"), F.date_format(matched, "yyyy-MM-dd").alias("matched")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("offset_days").cast("bigint").alias("offset_days"))


@query("asof_composite", sql=f"""
WITH {_COMPOSITES},
m AS (SELECT d, n, (SELECT max(c) FROM comp WHERE c <= d AND d - c <= 32) AS c FROM ships)
SELECT strftime(d, '%Y-%m-%d') AS date, strftime(c, '%Y-%m-%d') AS matched, n AS rows,
  CAST(d - c AS BIGINT) AS offset_days FROM m
""")
def asof_composite(spark, sf_dir):
    out = asof.asof_composite(_ships(spark, sf_dir), _composites(spark, sf_dir), "date", "composite")
    return _matched(out, "composite_date")


@query("asof_nearest_composite", sql=f"""
WITH {_COMPOSITES},
m AS (SELECT d, any_value(n) AS n, arg_min(c, abs(d - c) * 100000 + (c - DATE '1990-01-01')) AS c
  FROM ships LEFT JOIN comp ON abs(d - c) <= 32 GROUP BY d)
SELECT strftime(d, '%Y-%m-%d') AS date, strftime(c, '%Y-%m-%d') AS matched, n AS rows,
  CAST(d - c AS BIGINT) AS offset_days FROM m
""")
def asof_nearest_composite(spark, sf_dir):
    out = asof.asof_composite(_ships(spark, sf_dir), _composites(spark, sf_dir), "date", "composite",
                              no_future=False)
    return _matched(out, "composite_date")


@query("interval_composite", sql=f"""
WITH {_COMPOSITES},
m AS (SELECT d, any_value(n) AS n, max(c) AS c FROM ships LEFT JOIN comp ON d >= c AND d < c + 16 GROUP BY d)
SELECT strftime(d, '%Y-%m-%d') AS date, strftime(c, '%Y-%m-%d') AS matched, n AS rows,
  CAST(d - c AS BIGINT) AS offset_days FROM m
""")
def interval_composite(spark, sf_dir):
    out = asof.interval_composite(_ships(spark, sf_dir), _composites(spark, sf_dir), "date", "composite")
    return _matched(out, "composite_date")


@query("tolerance_match", sql=f"""
WITH {_COMPOSITES},
m AS (SELECT d, any_value(n) AS n, arg_min(c, abs(d - c) * 100000 + (c - DATE '1990-01-01')) AS c
  FROM ships JOIN comp ON abs(d - c) <= 3 GROUP BY d)
SELECT CAST(d - c AS BIGINT) AS offset_days, d >= c AS no_future, CAST(sum(n) AS BIGINT) AS rows FROM m GROUP BY 1, 2
""")
def tolerance_match(spark, sf_dir):
    out = asof.tolerance_match(_ships(spark, sf_dir), _composites(spark, sf_dir), "date", "composite",
                               how="inner")
    return out.groupBy(F.col("offset_days").cast("bigint").alias("offset_days"), "no_future").agg(
        F.count(F.lit(1)).alias("rows"))


@query("asof_by_region", sql="""
WITH comp AS (SELECT DISTINCT n_regionkey AS k, CAST(o_orderdate AS DATE) AS c FROM orders
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE dayofmonth(o_orderdate) = 1),
t AS (SELECT n_regionkey AS k, CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2),
m AS (SELECT k, d, n, (SELECT max(c) FROM comp WHERE comp.k = t.k AND c <= d AND d - c <= 32) AS c FROM t)
SELECT CAST(k AS BIGINT) AS region, CAST(sum(n) AS BIGINT) AS rows,
  CAST(coalesce(sum(n) FILTER (c IS NOT NULL), 0) AS BIGINT) AS matched_rows,
  CAST(max(d - c) AS BIGINT) AS max_offset FROM m GROUP BY 1
""")
def asof_by_region(spark, sf_dir):
    """Keyed as-of join: shipments against the latest first-of-month order of the region."""
    t = lambda name: domain.table(spark, sf_dir, name)
    nat = t("nation").select("n_nationkey", F.col("n_regionkey").cast("bigint").alias("region"))
    comp = (t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("region", F.when(F.dayofmonth("o_orderdate") == 1, F.to_date("o_orderdate")).alias("composite")))
    targets = (t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
               .join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
               .select("region", F.to_date("l_shipdate").alias("date")))
    out = asof.asof_composite(targets, comp, "date", "composite", by=["region"])
    return out.groupBy("region").agg(
        F.count(F.lit(1)).alias("rows"), F.count("composite_date").alias("matched_rows"),
        F.max("offset_days").cast("bigint").alias("max_offset"))


_CELL_SQL = """
WITH comp AS (SELECT DISTINCT l_suppkey % 97 AS k, CAST(l_shipdate AS DATE) AS c FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 15),
t AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 5 ELSE l_suppkey % 97 END AS k, CAST(l_receiptdate_ AS DATE) AS d, l_orderkey, l_linenumber
  FROM (SELECT *, l_shipdate + to_days(CAST(l_partkey % 20 AS INT)) AS l_receiptdate_ FROM lineitem)),
m AS (SELECT t.*, (SELECT max(c) FROM comp WHERE comp.k = t.k AND c <= d AND d - c <= 32) AS past,
    (SELECT arg_min(c, abs(d - c) * 100000 + (c - DATE '1990-01-01')) FROM comp WHERE comp.k = t.k AND abs(d - c) <= 5) AS near,
    (SELECT max(c) FROM comp WHERE comp.k = t.k AND c <= d AND d - c < 16) AS held FROM t)
"""


def _cell_composites(spark, sf_dir):
    li = domain.table(spark, sf_dir, "lineitem")
    return li.where("l_linenumber = 1 and l_quantity < 15").select((F.col("l_suppkey") % 97).alias("cell"), F.to_date("l_shipdate").alias("composite"))


def _cell_targets(spark, sf_dir):
    """A third of all rows are of one cell."""
    li = domain.table(spark, sf_dir, "lineitem")
    cell = F.when(F.col("l_orderkey") % 3 == 0, F.lit(5)).otherwise(F.col("l_suppkey") % 97)
    return li.select(cell.alias("cell"), F.date_add(F.to_date("l_shipdate"), (F.col("l_partkey") % 20).cast("int")).alias("date"), "l_orderkey", "l_linenumber")


@query("asof_by_cell", sql=f"""
{_CELL_SQL.strip()}
SELECT CAST(k AS BIGINT) AS cell, strftime(d, '%Y-%m-%d') AS date, CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  strftime(past, '%Y-%m-%d') AS matched, CAST(d - past AS INT) AS offset_days FROM m
""")
def asof_by_cell(spark, sf_dir):
    """Keyed as-of join as a merge: one row per target, a third of them of one cell."""
    out = asof.asof_composite(_cell_targets(spark, sf_dir), _cell_composites(spark, sf_dir), "date", "composite", by=["cell"])
    return out.select(F.col("cell").cast("long").alias("cell"), day("date"), F.col("l_orderkey").cast("long").alias("l_orderkey"),
                      F.col("l_linenumber").cast("long").alias("l_linenumber"), F.date_format("composite_date", "yyyy-MM-dd").alias("matched"), "offset_days")


@query("interval_by_cell", sql=f"""
{_CELL_SQL.strip()}
SELECT CAST(k AS BIGINT) AS cell, strftime(held, '%Y-%m-%d') AS matched, count(*) AS rows, CAST(max(d - held) AS INT) AS max_offset FROM m GROUP BY ALL
""")
def interval_by_cell(spark, sf_dir):
    out = asof.interval_composite(_cell_targets(spark, sf_dir), _cell_composites(spark, sf_dir), "date", "composite", by=["cell"])
    return out.groupBy(F.col("cell").cast("long").alias("cell"), F.date_format("composite_date", "yyyy-MM-dd").alias("matched")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("offset_days").alias("max_offset"))


@query("tolerance_by_cell", sql=f"""
{_CELL_SQL.strip()}
SELECT CAST(k AS BIGINT) AS cell, CAST(d - near AS INT) AS offset_days, d >= near AS no_future, count(*) AS rows FROM m WHERE near IS NOT NULL GROUP BY ALL
""")
def tolerance_by_cell(spark, sf_dir):
    out = asof.tolerance_match(_cell_targets(spark, sf_dir), _cell_composites(spark, sf_dir), "date", "composite", 5, by=["cell"], how="inner")
    return out.groupBy(F.col("cell").cast("long").alias("cell"), "offset_days", "no_future").agg(F.count(F.lit(1)).alias("rows"))


# --------------------------------------------------------------------- rasters


def _masked(spark, sf_dir):
    """Four products in one pixel table: layer, row, col, value, qa."""
    px = domain.pixels(spark, sf_dir)
    low = F.col("qa") == 6
    ndvi_raw = F.col("value") * 250.0 - 2500.0
    viirs_raw = F.when(low, F.lit(-999.9)).otherwise(F.col("discount") * 100.0 - 1.0)
    dem_raw = F.when(low, F.lit(-32768.0)).otherwise(F.col("value") * 200.0 - 600.0)
    layers = {
        "aod": masks.mask_aod(F.col("value") * 70.0, F.col("qa")),
        "ndvi": masks.mask_ndvi(ndvi_raw, F.col("qa")),
        "viirs": masks.mask_viirs(viirs_raw, F.col("qa")),
        "dem": masks.mask_dem(dem_raw),
    }
    items = F.array(*[F.struct(F.lit(n).alias("layer"), v.cast("double").alias("value"))
                      for n, v in layers.items()])
    return px.select("row", "col", "qa", "obs_date", F.explode(items).alias("l")).select(
        "l.layer", "row", "col", "qa", "obs_date", "l.value")


_MASKED = """
raw AS (SELECT row, col, qa, obs_date, value * 70.0::DOUBLE AS a, value * 250.0::DOUBLE - 2500.0::DOUBLE AS n,
  CASE WHEN qa = 6 THEN -999.9::DOUBLE ELSE discount * 100.0::DOUBLE - 1.0::DOUBLE END AS v,
  CASE WHEN qa = 6 THEN -32768.0::DOUBLE ELSE value * 200.0::DOUBLE - 600.0::DOUBLE END AS e FROM pixels),
masked AS (
  SELECT 'aod' AS layer, row, col, qa, obs_date, CASE WHEN (qa & 3) = 0 AND a * 0.001::DOUBLE > 0 AND a * 0.001::DOUBLE <= 3 THEN a * 0.001::DOUBLE END AS value FROM raw
  UNION ALL SELECT 'ndvi', row, col, qa, obs_date, CASE WHEN n <> -3000 AND n BETWEEN -2000 AND 10000 AND qa IN (0, 1)
    AND n * 0.0001::DOUBLE BETWEEN -0.2::DOUBLE AND 1.0::DOUBLE THEN n * 0.0001::DOUBLE END FROM raw
  UNION ALL SELECT 'viirs', row, col, qa, obs_date, CASE WHEN abs(v + 999.9::DOUBLE) >= 0.01::DOUBLE AND qa = 0 AND v >= 0 THEN v END FROM raw
  UNION ALL SELECT 'dem', row, col, qa, obs_date, CASE WHEN e <> -32768 THEN e END FROM raw)
"""


@query("layer_stats", parts=["pixels"], sql=f"""
WITH {_MASKED}
SELECT layer, count(*) AS total_pixels, count(value) AS valid_pixels, count(*) - count(value) AS nodata_pixels,
  ROUND(min(value), 6) AS min, ROUND(max(value), 6) AS max, ROUND(avg(value), 6) AS mean,
  ROUND(stddev_pop(value), 6) AS std, ROUND(count(value) * 100.0::DOUBLE / count(*), 6) AS coverage_percent,
  ROUND(quantile_cont(value, 0.5), 6) AS median FROM masked GROUP BY 1
""")
def layer_stats(spark, sf_dir):
    layers = materialize(_masked(spark, sf_dir).select("layer", "value"), "masked")
    return rounded(R.layer_stats(layers), "min", "max", "mean", "std",
                   "coverage_percent", "median")


@query("dem_plausibility", parts=["pixels"], sql="""
SELECT count(*) AS pixels, count(e) AS valid, count(*) FILTER (e NOT BETWEEN -500 AND 9000) AS suspicious
FROM (SELECT CASE WHEN qa <> 6 THEN value * 200.0::DOUBLE - 600.0::DOUBLE END AS e FROM pixels) x
""")
def dem_plausibility(spark, sf_dir):
    raw = F.when(F.col("qa") == 6, F.lit(-32768.0)).otherwise(F.col("value") * 200.0 - 600.0)
    px = domain.pixels(spark, sf_dir).select(masks.mask_dem(raw).alias("e"))
    return px.agg(F.count(F.lit(1)).alias("pixels"), F.count("e").alias("valid"),
                  F.count(F.when(masks.dem_suspicious(F.col("e")), 1)).alias("suspicious"))


@query("qa_histogram", parts=["pixels"], sql="""
SELECT 'ndvi' AS product, qa, count(*) AS pixels, CASE qa WHEN 0 THEN 'good data' WHEN 1 THEN 'marginal data'
  WHEN 2 THEN 'snow / ice' WHEN 3 THEN 'cloudy' ELSE 'unknown_code_' || qa END AS label FROM pixels GROUP BY 2
UNION ALL
SELECT 'viirs', qa, count(*), CASE qa WHEN 0 THEN 'high quality' WHEN 1 THEN 'poor quality'
  WHEN 2 THEN 'solar zenith 102-108 deg / poor' WHEN 3 THEN 'lunar eclipse' WHEN 4 THEN 'aurora'
  WHEN 5 THEN 'glint' ELSE 'unknown_code_' || qa END FROM pixels GROUP BY 2
""")
def qa_histogram(spark, sf_dir):
    px = domain.pixels(spark, sf_dir)
    ndvi = R.qa_histogram(px, "qa", masks.NDVI_QA_LABELS).withColumn("product", F.lit("ndvi"))
    viirs = R.qa_histogram(px, "qa", masks.VIIRS_QA_LABELS).withColumn("product", F.lit("viirs"))
    return ndvi.unionByName(viirs)


@query("zonal_stats", parts=["pixels"], sql=f"""
WITH {_MASKED}
SELECT layer, row // 4 AS row, col // 4 AS col, ROUND(avg(value), 6) AS mean,
  ROUND(count(value) / count(*)::DOUBLE, 6) AS valid_fraction, count(value) AS n_valid, count(*) AS n_pixels
FROM masked GROUP BY 1, 2, 3
""")
def zonal_stats(spark, sf_dir):
    stats = R.zonal_stats(_masked(spark, sf_dir), F.floor(F.col("row") / 4), F.floor(F.col("col") / 4),
                          by=["layer"])
    return rounded(stats, "mean", "valid_fraction")


@query("zonal_stats_all_cells", parts=["pixels"], sql="""
WITH m AS (SELECT max(row // 4) AS mr FROM pixels),
c AS (SELECT r.range AS row, c.range AS col FROM range((SELECT mr + 1 FROM m)) r, range(18) c),
z AS (SELECT row // 4 AS row, col // 4 AS col, avg(value) AS mean, count(*) AS n FROM pixels GROUP BY 1, 2)
SELECT c.row, c.col, ROUND(mean, 6) AS mean, CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS valid_fraction
FROM c LEFT JOIN z USING (row, col)
""")
def zonal_stats_all_cells(spark, sf_dir):
    """Zonal means on a grid two columns wider than the raster: empty cells stay."""
    px = domain.pixels(spark, sf_dir)
    stats = R.zonal_stats(px, F.floor(F.col("row") / 4), F.floor(F.col("col") / 4))
    last = px.agg(F.max(F.floor(F.col("row") / 4)).alias("r"))
    rows = last.select(F.explode(F.sequence(F.lit(0), F.col("r"))).alias("row"))
    cells = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(17)))).select(
        F.col("row").cast("bigint"), F.col("col").cast("bigint"))
    out = R.fill_cells(cells, stats)
    return out.select("row", "col", r6("mean").alias("mean"), r6("valid_fraction").alias("valid_fraction"))


@query("mosaic", parts=["pixels"], sql="""
WITH u AS (
  SELECT row, col, 1 AS o, value AS v FROM pixels WHERE qa < 4
  UNION ALL SELECT row, col, 2, CASE WHEN qa % 2 = 0 THEN price END FROM pixels WHERE qa >= 2)
SELECT row, col, ROUND(v, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY o DESC) AS rn FROM u) x WHERE rn = 1
""")
def mosaic(spark, sf_dir):
    """Two overlapping layers; the later one wins even where it is missing."""
    px = domain.pixels(spark, sf_dir)
    one = px.where(F.col("qa") < 4).select("row", "col", F.lit(1).alias("o"), F.col("value").alias("v"))
    two = px.where(F.col("qa") >= 2).select(
        "row", "col", F.lit(2).alias("o"), F.when(F.col("qa") % 2 == 0, F.col("price")).alias("v"))
    return rounded(R.mosaic(one.unionByName(two), "o"), "v")


@query("clip_and_rasterize", parts=["pixels"], sql="""
WITH c AS (SELECT row, col, CASE WHEN col + 0.5::DOUBLE > 10 AND col + 0.5::DOUBLE < 50 THEN value END AS value FROM pixels)
SELECT row, col, coalesce(value, -9999.0::DOUBLE) AS value FROM c
""")
def clip_and_rasterize(spark, sf_dir):
    px = domain.written_pixels(spark, sf_dir)
    x = F.col("col") + 0.5
    clipped = R.clip(px, (x > 10) & (x < 50)).where(F.col("value").isNotNull())
    return R.rasterize(clipped, px, "value", -9999.0)


@query("placed_pixels", parts=["pixels"], sql="""
SELECT row, col, CASE WHEN col < 60 THEN ROUND(500000.0::DOUBLE + (col + 0.5::DOUBLE) * 250.0::DOUBLE, 3) END AS x,
  CASE WHEN col < 60 THEN ROUND(3000000.0::DOUBLE + (row + 0.5::DOUBLE) * -250.0::DOUBLE, 3) END AS y,
  CASE WHEN col >= 60 OR value <> 7 THEN value END AS value FROM pixels
""")
def placed_pixels(spark, sf_dir):
    """Pixel coordinates from a layer table; nodata turns to NULL, and one layer is not in the table."""
    layer = F.when(F.col("col") < 60, "ndvi").otherwise("unknown")
    px = domain.pixels(spark, sf_dir).select(layer.alias("layer"), "row", "col", "value")
    meta = spark.createDataFrame(
        [("ndvi", 500000.0, 3000000.0, 250.0, -250.0, 7.0), ("dem", 0.0, 0.0, 30.0, -30.0, -32768.0)],
        "layer string, x0 double, y0 double, dx double, dy double, nodata double")
    return R.place_pixels(px, meta).select("row", "col", F.round("x", 3).alias("x"),
                                           F.round("y", 3).alias("y"), "value")


def _field(spark, sf_dir):
    return domain.weather(spark, sf_dir).groupBy("row", "col").agg(F.avg("temperature").alias("t"))


_FIELD = "field AS (SELECT row, col, avg(temperature) AS t FROM weather GROUP BY 1, 2)"


@query("interpolated_weather", parts=["weather", "stations"], sql=f"""
WITH {_FIELD},
p AS (SELECT station_id, (longitude - 77.0::DOUBLE) / 0.1::DOUBLE AS fx, (latitude - 28.4::DOUBLE) / 0.1::DOUBLE AS fy FROM stations),
k AS (SELECT *, fx BETWEEN 0 AND 4 AND fy BETWEEN 0 AND 4 AS ok, least(floor(fx), 3)::BIGINT AS c0, least(floor(fy), 3)::BIGINT AS r0 FROM p)
SELECT station_id, ROUND(CASE WHEN ok THEN a.t * (1.0::DOUBLE - (fx - c0)) * (1.0::DOUBLE - (fy - r0)) + b.t * (fx - c0) * (1.0::DOUBLE - (fy - r0))
  + c.t * (1.0::DOUBLE - (fx - c0)) * (fy - r0) + d.t * (fx - c0) * (fy - r0) END, 6) AS temperature
FROM k LEFT JOIN field a ON a.row = r0 AND a.col = c0 LEFT JOIN field b ON b.row = r0 AND b.col = c0 + 1
LEFT JOIN field c ON c.row = r0 + 1 AND c.col = c0 LEFT JOIN field d ON d.row = r0 + 1 AND d.col = c0 + 1
""")
def interpolated_weather(spark, sf_dir):
    out = R.interpolate_bilinear(domain.stations(spark, sf_dir), _field(spark, sf_dir),
                                 domain.WEATHER_GRID, "longitude", "latitude", "t", "temperature")
    return out.select("station_id", r6("temperature").alias("temperature"))


@query("sampled_layer", parts=["cell_static", "stations"], sql="""
WITH p AS (SELECT station_id, longitude, latitude, CAST(floor((longitude - 77.0::DOUBLE) / 0.05::DOUBLE) AS BIGINT) AS cell_col,
  CAST(floor((latitude - 28.4::DOUBLE) / 0.05::DOUBLE) AS BIGINT) AS cell_row,
  (longitude - 77.025::DOUBLE) / 0.05::DOUBLE AS fx, (latitude - 28.425::DOUBLE) / 0.05::DOUBLE AS fy FROM stations),
k AS (SELECT *, fx BETWEEN 0 AND 8 AND fy BETWEEN 0 AND 8 AS ok, least(floor(fx), 7)::BIGINT AS c0, least(floor(fy), 7)::BIGINT AS r0 FROM p)
SELECT station_id, ROUND(n.elevation_m, 6) AS nearest, ROUND(CASE WHEN ok THEN
  a.elevation_m * (1.0::DOUBLE - (fx - c0)) * (1.0::DOUBLE - (fy - r0)) + b.elevation_m * (fx - c0) * (1.0::DOUBLE - (fy - r0))
  + c.elevation_m * (1.0::DOUBLE - (fx - c0)) * (fy - r0) + d.elevation_m * (fx - c0) * (fy - r0) END, 5) AS bilinear
FROM k LEFT JOIN cell_static n ON n.cell_row = k.cell_row AND n.cell_col = k.cell_col
LEFT JOIN cell_static a ON a.cell_row = r0 AND a.cell_col = c0 LEFT JOIN cell_static b ON b.cell_row = r0 AND b.cell_col = c0 + 1
LEFT JOIN cell_static c ON c.cell_row = r0 + 1 AND c.cell_col = c0 LEFT JOIN cell_static d ON d.cell_row = r0 + 1 AND d.cell_col = c0 + 1
""")
def sampled_layer(spark, sf_dir):
    """One layer read at station positions, by cell and between cell centres."""
    layer = domain.cell_static(spark, sf_dir).withColumnsRenamed({"cell_row": "row", "cell_col": "col"})
    pts = domain.stations(spark, sf_dir).select("station_id", "longitude", "latitude")
    near = R.sample_layer(pts, layer, domain.STATION_GRID, "longitude", "latitude", "elevation_m", "nearest")
    both = R.sample_layer(near, layer, domain.STATION_GRID, "longitude", "latitude", "elevation_m",
                          "bilinear", method="bilinear")
    return both.select("station_id", r6("nearest").alias("nearest"), F.round("bilinear", 5).alias("bilinear"))


@query("warped_layer", parts=["pixels"], sql="""
WITH m AS (SELECT max(row) // 3 AS mr FROM pixels),
t AS (SELECT r.range AS trow, c.range AS tcol, c.range * 3.0::DOUBLE + 1.0::DOUBLE AS cx, r.range * 3.0::DOUBLE + 1.0::DOUBLE AS cy
  FROM range((SELECT mr + 1 FROM m)) r, range(21) c)
SELECT trow AS row, tcol AS col, p.value FROM t LEFT JOIN pixels p ON p.row = floor(cy) AND p.col = floor(cx)
""")
def warped_layer(spark, sf_dir):
    """A fine raster resampled by nearest pixel onto a grid three times coarser."""
    px = domain.pixels(spark, sf_dir)
    top = px.agg(F.max(F.floor(F.col("row") / 3)).alias("r"))
    target = top.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("r"))).alias("row")).withColumn(
        "col", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(20).cast("bigint"))))
    target = target.withColumns({"cx": F.col("col") * 3.0 + 1.0, "cy": F.col("row") * 3.0 + 1.0})
    source = Grid(0.0, 0.0, 1.0, 1.0, 2 ** 40, 64, 64.0, float(2 ** 40))
    return R.warp(target, px, source, "value", "nearest").select("row", "col", "value")


@query("nearest_valid_pixel", parts=["pixels"], sql="""
WITH q AS (SELECT o_orderkey AS id, o_orderkey // 64 AS qr, o_custkey % 70 AS qc FROM orders),
v AS (SELECT row, col, value FROM pixels WHERE qa <> 3 AND qa <> 5 AND value <= 25),
h AS (SELECT id, greatest(abs(row - qr), abs(col - qc)) AS ring, (row - qr) * (row - qr) + (col - qc) * (col - qc) AS d2,
   row - qr AS dr, col - qc AS dc, value
  FROM q JOIN (SELECT i.range - 2 AS i, j.range - 2 AS j FROM range(5) i, range(5) j) o ON TRUE
  JOIN v ON v.row = qr + i AND v.col = qc + j WHERE qc < 64),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ring, d2, dr, dc) AS rn FROM h) x WHERE rn = 1)
SELECT q.id, b.value AS found, CASE WHEN qc >= 64 THEN 'OUTSIDE_RASTER' WHEN b.id IS NOT NULL THEN 'AVAILABLE' ELSE 'NO_VALID_OBSERVATION' END AS status,
  CASE WHEN b.ring > 0 THEN 'nearest_valid_pixel' ELSE 'exact_pixel' END AS lookup,
  coalesce(CAST(round_even(sqrt(d2), 0) AS INT), 0) AS distance_pixels
FROM q LEFT JOIN b ON b.id = q.id
""")
def nearest_valid_pixel(spark, sf_dir):
    """A point per order, with fallback rings where its pixel is masked."""
    qa = F.col("qa")
    px = domain.pixels(spark, sf_dir).withColumn(
        "value", F.when((qa != 3) & (qa != 5) & (F.col("value") <= 25), F.col("value")))
    pts = domain.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 64).alias("qr"),
        (F.col("o_custkey") % 70).alias("qc"))
    out = R.nearest_valid_pixel(pts, px, "qr", "qc", F.col("qc") < 64)
    return out.select("id", "found", "status", "lookup", "distance_pixels")


# --------------------------------------------------------------------- weather


@query("weather_daily", parts=["weather"], sql="""
SELECT ROUND(latitude, 6) AS latitude, ROUND(longitude, 6) AS longitude, strftime(CAST(time AS DATE), '%Y-%m-%d') AS date,
  ROUND(avg(temperature), 6) AS temperature, ROUND(avg(relative_humidity), 6) AS relative_humidity,
  ROUND(sqrt(avg(u_wind) * avg(u_wind) + avg(v_wind) * avg(v_wind)), 6) AS wind_speed
FROM weather GROUP BY 1, 2, 3
""")
def weather_daily(spark, sf_dir):
    out = WX.weather_daily(domain.weather(spark, sf_dir))
    return out.select(r6("latitude").alias("latitude"), r6("longitude").alias("longitude"), day("date"),
                      *[r6(c).alias(c) for c in ("temperature", "relative_humidity", "wind_speed")])


@query("kelvin_weather", parts=["weather"], sql="""
SELECT row, count(*) AS rows, ROUND(avg(temperature_k - 273.15::DOUBLE), 6) AS mean_celsius,
  ROUND(avg(CASE WHEN NOT (abs(u_wind) > 1 OR abs(v_wind) > 1) THEN NULL WHEN degrees(atan2(v_wind, u_wind)) <= -90 THEN -90.0::DOUBLE - degrees(atan2(v_wind, u_wind))
    ELSE 270.0::DOUBLE - degrees(atan2(v_wind, u_wind)) END), 4) AS mean_direction
FROM weather GROUP BY 1
""")
def kelvin_weather(spark, sf_dir):
    from airq.functions.met import wind_direction_from
    u, v = F.col("u_wind"), F.col("v_wind")
    windy = (F.abs(u) > 1) | (F.abs(v) > 1)  # in calm air the direction means nothing
    return domain.weather(spark, sf_dir).groupBy("row").agg(
        F.count(F.lit(1)).alias("rows"),
        r6(F.avg(kelvin_to_celsius(F.col("temperature_k"), F.lit("K")))).alias("mean_celsius"),
        F.round(F.avg(F.when(windy, wind_direction_from(u, v))), 4).alias("mean_direction"))


@query("weather_qc", parts=["weather"], sql="""
WITH long AS (SELECT time, unnest(['temperature','relative_humidity','u_wind','v_wind']) AS variable,
  unnest([temperature, relative_humidity, u_wind, v_wind]) AS value FROM weather),
s AS (SELECT variable, time, count(value) AS v FROM long GROUP BY 1, 2)
SELECT l.variable, count(*) - count(value) AS nan_count, count(value) AS valid_count, count(*) AS total_count,
  ROUND((count(*) - count(value)) / count(*)::DOUBLE, 6) AS missing_fraction, ROUND(min(value), 6) AS min,
  ROUND(max(value), 6) AS max, ROUND(avg(value), 6) AS mean,
  (SELECT count(*) FROM s WHERE s.variable = l.variable AND v = 0) AS empty_time_slices
FROM long l GROUP BY 1
""")
def weather_qc(spark, sf_dir):
    return rounded(WX.weather_qc(domain.weather(spark, sf_dir)), "missing_fraction", "min", "max", "mean")


@query("weather_range_flags", parts=["weather"], sql="""
SELECT count(*) FILTER (temperature NOT BETWEEN -50 AND 60) AS temperature_out_of_range,
  count(*) FILTER (relative_humidity NOT BETWEEN 0 AND 100) AS humidity_out_of_bounds,
  count(*) FILTER (sqrt(u_wind * u_wind + v_wind * v_wind) > 60) AS wind_speed_suspicious,
  ROUND(max(sqrt(u_wind * u_wind + v_wind * v_wind)), 6) AS max_wind_speed FROM weather
""")
def weather_range_flags(spark, sf_dir):
    return rounded(WX.weather_range_flags(domain.weather(spark, sf_dir)), "max_wind_speed")


@query("weather_missing", parts=["weather"], sql="""
WITH d AS (SELECT latitude, longitude, CAST(time AS DATE) AS date, avg(temperature) AS t, avg(relative_humidity) AS h,
  avg(u_wind) AS u, avg(v_wind) AS v FROM weather GROUP BY 1, 2, 3),
long AS (SELECT latitude, longitude, date, unnest(['temperature','relative_humidity','u_wind','v_wind']) AS variable, unnest([t, h, u, v]) AS value FROM d),
c AS (SELECT variable, latitude, longitude, count(value) AS v, count(*) AS n FROM long GROUP BY 1, 2, 3),
e AS (SELECT variable, date, count(value) AS v FROM long GROUP BY 1, 2)
SELECT variable, CAST(sum(n - v) AS BIGINT) AS isolated_missing_values, count(*) FILTER (v = 0) AS missing_spatial_cells,
  (SELECT count(*) FROM e WHERE e.variable = c.variable AND e.v = 0) AS missing_entire_days FROM c GROUP BY 1
""")
def weather_missing(spark, sf_dir):
    return WX.weather_missing(WX.weather_daily(domain.weather(spark, sf_dir)))


@query("weather_missing_days", parts=["weather"], sql="""
WITH long AS (SELECT CAST(time AS DATE) AS date, unnest(['temperature','relative_humidity','u_wind','v_wind']) AS variable,
  unnest([temperature, relative_humidity, u_wind, v_wind]) AS value FROM weather)
SELECT variable, strftime(date, '%Y-%m-%d') AS date FROM long GROUP BY 1, 2 HAVING count(value) = 0
""")
def weather_missing_days(spark, sf_dir):
    out = WX.weather_missing_days(WX.weather_daily(domain.weather(spark, sf_dir)))
    return out.select("variable", day("date"))


@query("weather_summary", parts=["weather"], sql="""
WITH d AS (SELECT avg(temperature) AS t, avg(relative_humidity) AS h, avg(u_wind) AS u, avg(v_wind) AS v
  FROM weather WHERE time >= TIMESTAMP '1996-01-01' AND time < TIMESTAMP '1999-01-01'
   AND longitude BETWEEN 77.05 AND 77.35 AND latitude BETWEEN 28.45 AND 28.85 GROUP BY latitude, longitude, CAST(time AS DATE)),
long AS (SELECT unnest(['temperature','relative_humidity','u_wind','v_wind','wind_speed']) AS variable,
  unnest([t, h, u, v, sqrt(u * u + v * v)]) AS value FROM d)
SELECT variable, ROUND(min(value), 6) AS min, ROUND(max(value), 6) AS max, ROUND(avg(value), 6) AS mean,
  ROUND(stddev_pop(value), 6) AS std FROM long GROUP BY 1
""")
def weather_summary(spark, sf_dir):
    """Three years inside a box, then daily means, then the summary."""
    rows = WX.time_window(domain.weather(spark, sf_dir), "time", "1996-01-01", "1998-12-31")
    rows = WX.clip_weather(rows, (77.05, 28.45, 77.35, 28.85))
    return rounded(WX.weather_summary(WX.weather_daily(rows)), "min", "max", "mean", "std")


# ----------------------------------------------------------------------- roads


@query("road_validation", parts=["roads"], sql="""
SELECT count(*) AS input_roads, count(*) FILTER (n_points IS NULL) AS missing_geometry,
  CAST(0 AS BIGINT) AS empty_geometry, count(*) FILTER (n_points IS NOT NULL AND highway IS NULL) AS missing_highway,
  count(*) FILTER (highway IS NOT NULL AND n_points = 1) AS invalid_geometry,
  count(*) FILTER (highway IS NOT NULL AND n_points = 3) AS retained_roads FROM roads
""")
def road_validation(spark, sf_dir):
    return RD.road_attrition(RD.check_roads(domain.roads(spark, sf_dir)))


@query("roads_of_classes", parts=["roads"], sql="""
SELECT highway, count(*) AS roads, (SELECT count(*) FROM roads WHERE highway IS NULL OR highway = 'residential') AS dropped_roads
FROM roads WHERE highway IN ('primary', 'secondary') GROUP BY 1
""")
def roads_of_classes(spark, sf_dir):
    kept, dropped = RD.filter_highway(domain.roads(spark, sf_dir), domain.MAJOR_ROADS)
    return kept.groupBy("highway").agg(F.count(F.lit(1)).alias("roads")).withColumn(
        "dropped_roads", dropped.scalar())


@query("roads_in_box", parts=["roads"], sql="""
SELECT coalesce(highway, '(none)') AS highway, count(*) AS roads FROM roads
WHERE n_points IS NOT NULL AND least(x1, CASE WHEN n_points = 3 THEN least(x2, x3) ELSE x1 END) <= 20000
  AND greatest(x1, CASE WHEN n_points = 3 THEN greatest(x2, x3) ELSE x1 END) >= 10000
  AND least(y1, CASE WHEN n_points = 3 THEN least(y2, y3) ELSE y1 END) <= 25000
  AND greatest(y1, CASE WHEN n_points = 3 THEN greatest(y2, y3) ELSE y1 END) >= 5000 GROUP BY 1
""")
def roads_in_box(spark, sf_dir):
    inside = lines_in_box(domain.roads(spark, sf_dir), (10000.0, 5000.0, 20000.0, 25000.0))
    return inside.groupBy(F.coalesce("highway", F.lit("(none)")).alias("highway")).agg(
        F.count(F.lit(1)).alias("roads"))


def _pieces(spark, sf_dir):
    good = RD.check_roads(domain.roads(spark, sf_dir)).where(F.col("reject_reason").isNull())
    return RD.cut_segments(RD.split_segments(good, "road_id", "highway"), domain.ROAD_GRID, "highway")


_PIECES = """
seg AS (SELECT highway, road_id * 2 AS sid, x1, y1, x2, y2 FROM roads WHERE n_points = 3 AND highway IS NOT NULL
  UNION ALL SELECT highway, road_id * 2 + 1, x2, y2, x3, y3 FROM roads WHERE n_points = 3 AND highway IS NOT NULL),
num AS (SELECT *, row_number() OVER () AS k FROM seg),
cut AS (
  SELECT k, 0.0::DOUBLE AS t FROM num UNION SELECT k, 1.0::DOUBLE FROM num
  UNION SELECT k, (i * 1000.0::DOUBLE - x1) / (x2 - x1) FROM (SELECT *, unnest(range(CAST(floor(least(x1, x2) / 1000) + 1 AS BIGINT), CAST(ceil(greatest(x1, x2) / 1000) AS BIGINT))) AS i FROM num) a
  UNION SELECT k, (i * 1000.0::DOUBLE - y1) / (y2 - y1) FROM (SELECT *, unnest(range(CAST(floor(least(y1, y2) / 1000) + 1 AS BIGINT), CAST(ceil(greatest(y1, y2) / 1000) AS BIGINT))) AS i FROM num) b
  UNION SELECT k, (39500.0::DOUBLE - x1) / (x2 - x1) FROM num WHERE (39500 - x1) * (39500 - x2) < 0
  UNION SELECT k, (39500.0::DOUBLE - y1) / (y2 - y1) FROM num WHERE (39500 - y1) * (39500 - y2) < 0),
seq AS (SELECT k, t, lead(t) OVER (PARTITION BY k ORDER BY t) AS t2 FROM cut),
mid AS (SELECT highway, x1 + (t + t2) / 2 * (x2 - x1) AS mx, y1 + (t + t2) / 2 * (y2 - y1) AS my,
  sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) * (t2 - t) AS len FROM seq JOIN num USING (k) WHERE t2 IS NOT NULL),
piece AS (SELECT highway, CAST(floor(my / 1000) AS BIGINT) AS row, CAST(floor(mx / 1000) AS BIGINT) AS col, len FROM mid
  WHERE mx >= 0 AND mx <= 39500 AND my >= 0 AND my <= 39500),
cells AS (SELECT r.range AS row, c.range AS col, CASE WHEN r.range = 39 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END
   * CASE WHEN c.range = 39 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS area FROM range(40) r, range(40) c),
dens AS (SELECT row, col, area, coalesce(sum(len), 0.0::DOUBLE) AS total,
  coalesce(sum(len) FILTER (highway IN ('primary', 'secondary')), 0.0::DOUBLE) AS major FROM cells LEFT JOIN piece USING (row, col) GROUP BY 1, 2, 3)
"""


@query("road_density", parts=["roads"], sql=f"""
WITH {_PIECES}
SELECT row, col, ROUND(area, 6) AS area_km2, ROUND(total / area, 3) AS road_density, ROUND(major / area, 3) AS major_road_density FROM dens
""")
def road_density(spark, sf_dir):
    cells = G.make_grid(spark, domain.ROAD_GRID)
    out = RD.road_density(cells, _pieces(spark, sf_dir), domain.MAJOR_ROADS)
    return out.select("row", "col", r6("area_km2").alias("area_km2"),
                      F.round("road_density", 3).alias("road_density"),
                      F.round("major_road_density", 3).alias("major_road_density"))


@query("road_report", parts=["roads"], sql=f"""
WITH {_PIECES}
SELECT count(*) AS n_cells, count(*) FILTER (total > 0) AS cells_with_roads, count(*) FILTER (total = 0) AS cells_without_roads,
  ROUND(min(total / area) FILTER (total > 0), 3) AS min_density, ROUND(max(total / area) FILTER (total > 0), 3) AS max_density,
  ROUND(avg(total / area) FILTER (total > 0), 3) AS mean_density, ROUND(sum(total), 2) AS total_length_m FROM dens
""")
def road_report(spark, sf_dir):
    cells = G.make_grid(spark, domain.ROAD_GRID)
    out = RD.road_report(RD.road_density(cells, _pieces(spark, sf_dir), domain.MAJOR_ROADS))
    return rounded(out, "min_density", "max_density", "mean_density", digits=3).withColumn(
        "total_length_m", F.round("total_length_m", 2))


@query("road_counts_by_tile", sql="""
WITH t AS (SELECT 'tile_' || lpad(CAST(s_suppkey % 36 AS VARCHAR), 3, '0') || '_' || lpad(CAST(s_suppkey % 18 AS VARCHAR), 3, '0') AS tile_id,
  count(*) * 3 AS road_segments FROM supplier GROUP BY 1),
p AS (SELECT c_custkey, 'tile_' || lpad(CAST(least(floor((c_custkey * 37 % 3601) / 100.0::DOUBLE), 35)::INT AS VARCHAR), 3, '0') || '_'
   || lpad(CAST(least(floor((c_custkey * 17 % 1801) / 100.0::DOUBLE), 17)::INT AS VARCHAR), 3, '0') AS tile_id FROM customer)
SELECT c_custkey, tile_id, CAST(road_segments AS DOUBLE) AS road_density, road_segments IS NOT NULL AS road_density_available FROM p LEFT JOIN t USING (tile_id)
""")
def road_counts_by_tile(spark, sf_dir):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    tiles = domain.table(spark, sf_dir, "supplier").groupBy(
        F.format_string("tile_%03d_%03d", s % 36, s % 18).alias("tile_id")).agg(
        (F.count(F.lit(1)) * 3).alias("road_segments"))
    pts = domain.table(spark, sf_dir, "customer").select(
        "c_custkey", ((k * 37 % 3601) / 10.0 - 180.0).alias("longitude"),
        ((k * 17 % 1801) / 10.0 - 90.0).alias("latitude"))
    return RD.road_counts_by_tile(pts, tiles).select(
        "c_custkey", "tile_id", "road_density", "road_density_available")
