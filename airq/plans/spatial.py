"""Queries on zones, interpolation, nearest stations and autocorrelation."""

from __future__ import annotations

from pyspark.sql import functions as F

from airq.functions import aqi
from airq.operators import autocorr as A, grid as G, nearest as N, reports as RP, scattered as S, zones as Z
from airq.operators.grid import Grid
from airq.operators.ranks import benjamini_hochberg
from airq.plans.registry import query, r6, rounded
from airq.plans.sql_parts import aqi_sql, category_sql, part, permutation_sql
from airq.session import materialize
from airq.sources import domain, sinks

FINE = Grid(77.0, 28.4, 0.02, 0.02, 21, 21, 77.42, 28.82)

part("hot", f"""
SELECT * FROM (SELECT *, {category_sql('aqi')} AS category FROM (
  SELECT row, col, value * 5.0::DOUBLE AS pm25, round_even({aqi_sql('(value * 5.0::DOUBLE)')}, 0) AS aqi FROM pixels) a) b
WHERE category IN ('VERY_POOR', 'SEVERE')
""", "pixels")

# Components by minimum spreading along the four sides.
_ZONES = """
WITH RECURSIVE run AS (
  SELECT row, col, min(col) OVER (PARTITION BY row, g) AS c0 FROM (
    SELECT *, col - row_number() OVER (PARTITION BY row ORDER BY col) AS g FROM hot) x),
node AS (SELECT DISTINCT row * 64 + c0 AS n FROM run),
link AS (SELECT DISTINCT a.row * 64 + a.c0 AS x, b.row * 64 + b.c0 AS y FROM run a JOIN run b ON b.row = a.row + 1 AND b.col = a.col),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
lab(n, l) USING KEY (n) AS (
  SELECT n, n FROM node
  UNION
  SELECT e.y, min(lab.l) FROM lab JOIN edge e ON e.x = lab.n JOIN recurring.lab r ON r.n = e.y WHERE lab.l < r.l GROUP BY e.y),
zoned AS (SELECT run.row, run.col, lab.l AS zone FROM run JOIN lab ON lab.n = run.row * 64 + run.c0)
"""


def _aqi_cells(spark, sf_dir):
    px = domain.pixels(spark, sf_dir).select("row", "col", (F.col("value") * 5.0).alias("pm25"))
    px = px.withColumn("aqi", aqi.round_aqi(aqi.pm25_to_aqi(F.col("pm25"))))
    return px.withColumn("aqi_category", aqi.aqi_category(F.col("aqi")))


def _hot(spark, sf_dir):
    return Z.hotspot_mask(_aqi_cells(spark, sf_dir))


@query("hotspot_mask", parts=["hot"], sql="""
SELECT category, count(*) AS cells, ROUND(avg(pm25), 6) AS mean_pm25, ROUND(max(aqi), 6) AS max_aqi FROM hot GROUP BY 1
""")
def hotspot_mask(spark, sf_dir):
    return _hot(spark, sf_dir).groupBy(F.col("aqi_category").alias("category")).agg(
        F.count(F.lit(1)).alias("cells"), r6(F.avg("pm25")).alias("mean_pm25"),
        r6(F.max("aqi").cast("double")).alias("max_aqi"))


@query("hotspot_zones", parts=["hot"], sql=f"""
{_ZONES}
SELECT row_number() OVER (ORDER BY zone) AS hotspot_id, count(*) AS n_cells, ROUND(count(*) * 0.25::DOUBLE, 6) AS area_km2,
  min(row) AS min_row, max(row) AS max_row, min(col) AS min_col, max(col) AS max_col FROM zoned GROUP BY zone
""")
def hotspot_zones(spark, sf_dir):
    labelled = Z.label_zones(_hot(spark, sf_dir), domain.PIXEL_COLS)
    return rounded(Z.hotspot_zones(labelled, 0.25), "area_km2")


@query("hotspot_statistics", parts=["hot"], sql=f"""
{_ZONES}
SELECT (SELECT count(*) FROM hot) AS hotspot_cell_count, (SELECT count(DISTINCT zone) FROM zoned) AS hotspot_zone_count,
  ROUND(count(*) * 0.25::DOUBLE, 6) AS hotspot_area_km2, ROUND(avg(pm25), 6) AS mean_pm25, ROUND(max(pm25), 6) AS max_pm25,
  ROUND(avg(aqi), 6) AS mean_aqi, CAST(max(aqi) AS BIGINT) AS max_aqi FROM hot
""")
def hotspot_statistics(spark, sf_dir):
    hot = materialize(_hot(spark, sf_dir), "hot")
    zones = Z.hotspot_zones(Z.label_zones(hot, domain.PIXEL_COLS), 0.25)
    return rounded(Z.hotspot_statistics(hot, zones, "pm25", "aqi"), "hotspot_area_km2", "mean_pm25",
                   "max_pm25", "mean_aqi")


@query("zones_geojson", parts=["hot"], sql=f"""
{_ZONES},
z AS (SELECT row_number() OVER (ORDER BY zone) AS hotspot_id, count(*) AS n, min(row) * 500.0::DOUBLE AS s, (max(row) + 1) * 500.0::DOUBLE AS n_,
  min(col) * 500.0::DOUBLE AS w, (max(col) + 1) * 500.0::DOUBLE AS e FROM zoned GROUP BY zone)
SELECT CAST(to_json(struct_pack(type := 'Feature', properties := struct_pack(hotspot_id := hotspot_id, area_km2 := n * 0.25::DOUBLE, n_cells := n),
  geometry := struct_pack(type := 'Polygon', coordinates := [[[w, s], [e, s], [e, n_], [w, n_], [w, s]]]))) AS VARCHAR) AS value FROM z
""")
def zones_geojson(spark, sf_dir):
    """One GeoJSON feature per zone."""
    zones = Z.hotspot_zones(Z.label_zones(_hot(spark, sf_dir), domain.PIXEL_COLS), 0.25)
    side = 500.0
    return sinks.geojson_features(
        zones, F.col("min_col") * side, F.col("min_row") * side, (F.col("max_col") + 1) * side,
        (F.col("max_row") + 1) * side, ["hotspot_id", "area_km2", "n_cells"])


_AREA_COLS = 60


@query("final_checks", parts=["hot"], sql=f"""
{_ZONES},
z AS (SELECT max(row) AS bottom, max(col) AS side FROM zoned GROUP BY zone),
area AS (SELECT max(o_orderkey) // 64 + 1 AS n_rows FROM orders),
cell AS (SELECT row, col, CASE WHEN (row + col) % 101 <> 0 THEN value END AS pm25, {category_sql('aqi')} AS category,
    CASE WHEN (row + 2 * col) % 103 <> 0 THEN aqi + CASE WHEN (row + 3 * col) % 107 = 0 THEN 1000 ELSE 0 END END AS aqi
  FROM (SELECT row, col, value, round_even({aqi_sql('(value * 5.0::DOUBLE)')}, 0) AS aqi FROM pixels) a),
c AS (
  SELECT 'every_index_has_a_concentration' AS "check", count(*) FILTER (aqi IS NOT NULL AND pm25 IS NULL) AS violations FROM cell
  UNION ALL SELECT 'every_category_has_an_index', count(*) FILTER (category IS NOT NULL AND aqi IS NULL) FROM cell
  UNION ALL SELECT 'index_in_range', count(*) FILTER (aqi NOT BETWEEN 0 AND 500) FROM cell
  UNION ALL SELECT 'cells_in_area', count(*) FILTER (row >= n_rows OR col >= {_AREA_COLS}) FROM cell, area
  UNION ALL SELECT 'one_grid_for_both_products', count(*) FILTER ((row + col) % 109 = 0) FROM cell
  UNION ALL SELECT 'hot_cells_have_a_concentration', count(*) FROM hot WHERE (row + col) % 101 = 0
  UNION ALL SELECT 'zones_in_area', count(*) FILTER (bottom >= n_rows OR side >= {_AREA_COLS}) FROM z, area)
SELECT "check", violations, violations = 0 AS passed FROM c
""")
def final_checks(spark, sf_dir):
    """All cells and zones; gaps and wrong values are planted, and the area is declared too narrow."""
    cells = materialize(_aqi_cells(spark, sf_dir), "index-cells")
    hot = Z.hotspot_mask(cells)
    zones = Z.hotspot_zones(Z.label_zones(hot, domain.PIXEL_COLS), 0.25)
    row, col = F.col("row"), F.col("col")
    planted = cells.withColumns({
        "pm25": F.when((row + col) % 101 != 0, F.col("pm25")),
        "aqi": F.when((row + 2 * col) % 103 != 0, F.col("aqi") + F.when((row + 3 * col) % 107 == 0, 1000).otherwise(0))})
    last = domain.table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("k")).first()["k"]
    return RP.final_checks(planted, zones, last // domain.PIXEL_COLS + 1, _AREA_COLS,
                           concentration=cells.where((row + col) % 109 != 0), hot=hot)


# -------------------------------------------------- nearest stations and IDW


def _cells(spark, sf_dir):
    """Fine grid cells, some moved far away so that every fallback is used."""
    cells = G.make_grid(spark, FINE)
    away = F.pmod(F.col("row") + F.col("col"), F.lit(17)) == 0
    return cells.select("grid_id", F.when(away, F.col("cx") + 3.0).otherwise(F.col("cx")).alias("longitude"),
                        F.col("cy").alias("latitude"))


part("fine", """
SELECT lpad(CAST(c.range AS VARCHAR), 3, '0') || '_' || lpad(CAST(r.range AS VARCHAR), 3, '0') AS grid_id,
  77.0::DOUBLE + c.range * 0.02::DOUBLE + (least(77.0::DOUBLE + c.range * 0.02::DOUBLE + 0.02::DOUBLE, 77.42::DOUBLE) - (77.0::DOUBLE + c.range * 0.02::DOUBLE)) / 2.0::DOUBLE
    + CASE WHEN (r.range + c.range) % 17 = 0 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS longitude,
  28.4::DOUBLE + r.range * 0.02::DOUBLE + (least(28.4::DOUBLE + r.range * 0.02::DOUBLE + 0.02::DOUBLE, 28.82::DOUBLE) - (28.4::DOUBLE + r.range * 0.02::DOUBLE)) / 2.0::DOUBLE AS latitude
FROM range(21) r, range(21) c
""")


@query("nearest_station", parts=["stations", "fine"], sql="""
WITH d AS (SELECT grid_id, 2.0::DOUBLE * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(
    power(sin((radians(s.latitude) - radians(f.latitude)) / 2), 2) + cos(radians(f.latitude)) * cos(radians(s.latitude))
    * power(sin((radians(s.longitude) - radians(f.longitude)) / 2), 2)))) AS km FROM fine f, stations s)
SELECT grid_id, ROUND(min(km), 5) AS distance_km FROM d GROUP BY 1
""")
def nearest_station(spark, sf_dir):
    out = N.nearest_station(_cells(spark, sf_dir), domain.stations(spark, sf_dir), "grid_id", "station_id")
    return out.select("grid_id", F.round("distance_km", 5).alias("distance_km"))


@query("nearest_three_stations", parts=["stations", "fine"], sql="""
WITH d AS (SELECT grid_id, station_id, sqrt((f.longitude - s.longitude) ** 2 + (f.latitude - s.latitude) ** 2) AS dist FROM fine f, stations s),
n AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY dist, station_id) AS rank FROM d)
SELECT grid_id, CAST(rank AS INT) AS rank, station_id, ROUND(dist, 6) AS distance FROM n WHERE rank <= 3
""")
def nearest_three_stations(spark, sf_dir):
    cells, stations = _cells(spark, sf_dir), domain.stations(spark, sf_dir)
    out = N.k_nearest(cells, stations, ["longitude", "latitude"], 3, "grid_id", "station_id", 0.02)
    return out.select("grid_id", "rank", "station_id", r6("distance").alias("distance"))


def _customers(spark, sf_dir):
    """Positions of all customers; some far from every station, some on the other side of the earth."""
    key = F.col("c_custkey")
    far = F.when(key % 101 == 0, 180.0).when(key % 17 == 0, 3.0).otherwise(0.0)
    return domain.table(spark, sf_dir, "customer").select(
        key.alias("customer"), (F.lit(77.0) + (key * 37 % 4200) / 10000.0 - far).alias("longitude"),
        (F.lit(28.4) + (key * 91 % 4200) / 10000.0).alias("latitude"))


part("customer_points", """
SELECT c_custkey AS customer, 77.0::DOUBLE + (c_custkey * 37 % 4200) / 10000.0::DOUBLE
    - CASE WHEN c_custkey % 101 = 0 THEN 180.0::DOUBLE WHEN c_custkey % 17 = 0 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS longitude,
  28.4::DOUBLE + (c_custkey * 91 % 4200) / 10000.0::DOUBLE AS latitude FROM customer
""")


@query("nearest_station_of_customers", parts=["stations", "customer_points"], sql="""
WITH d AS (SELECT customer, station_id, 2.0::DOUBLE * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(
    power(sin((radians(s.latitude) - radians(c.latitude)) / 2), 2) + cos(radians(c.latitude)) * cos(radians(s.latitude))
    * power(sin((radians(s.longitude) - radians(c.longitude)) / 2), 2)))) AS km FROM customer_points c, stations s)
SELECT customer, arg_min(station_id, (km, station_id)) AS station_id, ROUND(min(km), 5) AS distance_km FROM d GROUP BY 1
""")
def nearest_station_of_customers(spark, sf_dir):
    """The asking side grows with the data; of stations at one distance the smallest id is taken."""
    out = N.nearest_station(_customers(spark, sf_dir), domain.stations(spark, sf_dir), "customer", "station_id")
    return out.select("customer", "station_id", F.round("distance_km", 5).alias("distance_km"))


@query("idw_at_customers", parts=["stations", "customer_points"], sql="""
WITH d AS (SELECT customer, station_id, pm25, sqrt((c.longitude - s.longitude) ** 2 + (c.latitude - s.latitude) ** 2) AS dist FROM customer_points c, stations s),
g AS (SELECT customer, min(dist) AS closest, arg_min(pm25, (dist, station_id)) AS own,
  sum(pm25 / (dist ** 2 + 1e-10)) FILTER (dist < 0.5::DOUBLE) / sum(1.0::DOUBLE / (dist ** 2 + 1e-10)) FILTER (dist < 0.5::DOUBLE) AS weighted FROM d GROUP BY 1)
SELECT customer, CASE WHEN closest < 1e-6 THEN 'station' WHEN weighted IS NOT NULL THEN 'weighted' ELSE 'nearest' END AS idw_method,
  ROUND(CASE WHEN closest < 1e-6 THEN own ELSE coalesce(weighted, own) END, 6) AS idw FROM g
""")
def idw_at_customers(spark, sf_dir):
    out = N.idw(_customers(spark, sf_dir), domain.stations(spark, sf_dir), "customer", "pm25")
    return out.select("customer", "idw_method", r6("idw").alias("idw"))


@query("station_neighbours", parts=["stations"], sql="""
SELECT a.station_id, count(b.station_id) AS neighbours, ROUND(coalesce(sum(b.pm25), 0.0::DOUBLE), 8) AS nbr_sum
FROM stations a LEFT JOIN stations b ON a.station_id <> b.station_id
  AND sqrt((a.longitude - b.longitude) ** 2 + (a.latitude - b.latitude) ** 2) <= 0.03::DOUBLE GROUP BY 1
""")
def station_neighbours(spark, sf_dir):
    """Number and sum of the stations around each station."""
    stations = domain.stations(spark, sf_dir)
    out = A.neighbour_sums_within(stations, "station_id", ["longitude", "latitude"], "pm25", 0.03)
    near = F.when(F.col("nbr_count") > 0, F.col("nbr_sum")).otherwise(0.0)
    return out.select("station_id", F.col("nbr_count").alias("neighbours"), r6(near, 8).alias("nbr_sum"))


@query("neighbour_threshold", parts=["stations"], sql="""
WITH d AS (SELECT a.station_id, min(sqrt((a.longitude - b.longitude) ** 2 + (a.latitude - b.latitude) ** 2)) AS m
  FROM stations a JOIN stations b ON a.station_id <> b.station_id GROUP BY 1)
SELECT ROUND(quantile_cont(m, 0.5) * 1.5::DOUBLE, 6) AS threshold FROM d
""")
def neighbour_threshold(spark, sf_dir):
    """1.5 times the median distance between a station and its nearest other one."""
    return rounded(A.queen_threshold(domain.stations(spark, sf_dir), "station_id",
                                     ["longitude", "latitude"], 0.01), "threshold")


@query("idw_surface", parts=["stations", "fine"], sql="""
WITH d AS (SELECT grid_id, station_id, pm25, sqrt((f.longitude - s.longitude) ** 2 + (f.latitude - s.latitude) ** 2) AS dist FROM fine f, stations s)
SELECT grid_id, ROUND(CASE WHEN min(dist) < 1e-6 THEN arg_min(pm25, dist)
   WHEN count(*) FILTER (dist < 0.5) = 0 THEN arg_min(pm25, dist)
   ELSE sum(pm25 / (dist * dist + 1e-10::DOUBLE)) FILTER (dist < 0.5) / sum(1.0::DOUBLE / (dist * dist + 1e-10::DOUBLE)) FILTER (dist < 0.5) END, 5) AS idw,
  CASE WHEN min(dist) < 1e-6 THEN 'station' WHEN count(*) FILTER (dist < 0.5) = 0 THEN 'nearest' ELSE 'weighted' END AS idw_method
FROM d GROUP BY 1
""")
def idw_surface(spark, sf_dir):
    out = N.idw(_cells(spark, sf_dir), domain.stations(spark, sf_dir), "grid_id", "pm25")
    return out.select("grid_id", F.round("idw", 5).alias("idw"), "idw_method")


# -------------------------------------------------------------- autocorrelation

part("blocks", "SELECT row // 4 AS row, col // 4 AS col, avg(value) AS v FROM pixels GROUP BY 1, 2", "pixels")
part("around", """
SELECT a.row, a.col, any_value(a.v) AS v, count(b.v) AS w, coalesce(sum(b.v), 0.0::DOUBLE) AS s FROM blocks a
LEFT JOIN blocks b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND NOT (a.row = b.row AND a.col = b.col)
  AND b.row BETWEEN a.row - 1 AND a.row + 1 GROUP BY 1, 2
""", "blocks")


def _blocks(spark, sf_dir):
    return materialize(domain.pixels(spark, sf_dir).groupBy(
        F.floor(F.col("row") / 4).alias("row"), F.floor(F.col("col") / 4).alias("col")).agg(
        F.avg("value").alias("v")), "blocks")


@query("local_moran", parts=["around"], sql="""
WITH m AS (SELECT avg(v) AS mu, stddev_samp(v) + 1e-10::DOUBLE AS sd FROM blocks),
z AS (SELECT row, col, w, (v - mu) / sd AS z, CASE WHEN w > 0 THEN (s - w * mu) / sd / w ELSE 0.0::DOUBLE END AS lag FROM around, m)
SELECT row, col, ROUND(z, 5) AS z, ROUND(CASE WHEN w > 0 THEN z * lag ELSE 0.0::DOUBLE END, 5) AS moran_i, w AS neighbours,
  CASE WHEN z > 0 AND lag > 0 THEN 'HH' WHEN z > 0 THEN 'HL' WHEN lag > 0 THEN 'LH' ELSE 'LL' END AS quadrant FROM z
""")
def local_moran(spark, sf_dir):
    out = A.local_moran(_blocks(spark, sf_dir), "v")
    return out.select("row", "col", F.round("z", 5).alias("z"), F.round("moran_i", 5).alias("moran_i"),
                      F.col("nbr_count").alias("neighbours"), "quadrant")


@query("getis_ord", parts=["around"], sql="""
WITH m AS (SELECT avg(v) AS mu, stddev_samp(v) AS sd, count(*) AS n FROM blocks)
SELECT row, col, ROUND(CASE WHEN sd * sqrt((n * w - w * w) / (n - 1)::DOUBLE) < 1e-10 THEN 0.0::DOUBLE
    ELSE (s - mu * w) / (sd * sqrt((n * w - w * w) / (n - 1)::DOUBLE)) END, 5) AS gi,
  ROUND((s + v - mu * (w + 1)) / (sd * sqrt((n * (w + 1) - (w + 1) * (w + 1)) / (n - 1)::DOUBLE)), 5) AS gi_star FROM around, m
""")
def getis_ord(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    plain = A.getis_ord(blocks, "v").select("row", "col", "v", F.col("gi").alias("g"))
    star = A.getis_ord(blocks, "v", include_self=True).select("row", "col", F.col("gi").alias("gs"))
    return plain.join(star, ["row", "col"]).select(
        "row", "col", F.round("g", 5).alias("gi"), F.round("gs", 5).alias("gi_star"))


@query("significant_blocks", parts=["around"], sql="""
WITH m AS (SELECT avg(v) AS mu, stddev_samp(v) AS sd, count(*) AS n FROM blocks),
g AS (SELECT row, col, abs((s - mu * w) / (sd * sqrt((n * w - w * w) / (n - 1)::DOUBLE))) / sqrt(2.0::DOUBLE) AS a FROM around, m),
t AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * a) AS t FROM g),
p AS (SELECT row, col, t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE
   + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-a * a) AS p FROM t),
k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p),
c AS (SELECT max(p) AS cut FROM k WHERE p <= 0.2::DOUBLE * k / m)
SELECT row, col, ROUND(p, 6) AS p_value, coalesce(p <= cut, FALSE) AS significant FROM p, c
""")
def significant_blocks(spark, sf_dir):
    """Analytic p-values of the standardised statistic under FDR control."""
    tested = materialize(A.analytic_p(A.getis_ord(_blocks(spark, sf_dir), "v"), "gi"), "tested")
    out = benjamini_hochberg(tested, "p_value", alpha=0.2)
    return out.select("row", "col", r6("p_value").alias("p_value"), "significant")


_BLOCK_TEST = """
WITH RECURSIVE cells AS (SELECT row_number() OVER (ORDER BY row, col) - 1 AS pos, row, col, v AS x FROM blocks),
pairs AS (SELECT a.pos, b.pos AS other FROM cells a JOIN cells b ON b.row BETWEEN a.row - 1 AND a.row + 1
  AND b.col BETWEEN a.col - 1 AND a.col + 1 AND a.pos <> b.pos),
"""


@query("permutation_hotspots", parts=["blocks"], sql=f"""
{_BLOCK_TEST.strip()}
{permutation_sql("cells", "pairs", ("lisa",)).strip()}
SELECT count(*) AS n_cells, count(*) FILTER (cluster_type = 'HOTSPOT') AS n_significant_hotspots,
  count(*) FILTER (cluster_type = 'COLDSPOT') AS n_significant_coldspots, ROUND(avg(statistic), 6) AS mean_statistic,
  ROUND(max(statistic), 6) AS max_statistic, ROUND(min(statistic), 6) AS min_statistic, ROUND(avg(p_value), 6) AS mean_p_value,
  CASE WHEN count(*) < 30 THEN 'DEFERRED' ELSE 'COMPUTED' END AS status FROM classes
""")
def permutation_hotspots(spark, sf_dir):
    """Permutation test per class, with the same permutations in SQL."""
    tested = A.hotspot_analysis(_blocks(spark, sf_dir), "v", "lisa")
    return rounded(A.hotspot_summary(tested), "mean_statistic", "max_statistic", "min_statistic",
                   "mean_p_value")


@query("permutation_getis_ord", parts=["blocks"], sql=f"""
{_BLOCK_TEST.strip()}
{permutation_sql("cells", "pairs", ("getis_ord",)).strip()}
SELECT cluster_type, count(*) AS cells FROM classes GROUP BY cluster_type
""")
def permutation_getis_ord(spark, sf_dir):
    tested = A.hotspot_analysis(_blocks(spark, sf_dir), "v", "getis_ord")
    return tested.groupBy("cluster_type").agg(F.count(F.lit(1)).alias("cells"))


_SCATTERED = """
WITH RECURSIVE cells AS (SELECT row_number() OVER (ORDER BY latitude, longitude, pm25) - 1 AS pos, latitude, longitude, pm25 AS x FROM stations),
far AS (SELECT a.pos, b.pos AS other, sqrt((a.longitude - b.longitude) ** 2 + (a.latitude - b.latitude) ** 2) AS d FROM cells a JOIN cells b ON a.pos <> b.pos),
reach AS (SELECT quantile_cont(d, 0.5) * 1.5::DOUBLE AS reach FROM (SELECT min(d) AS d FROM far GROUP BY pos)),
pairs AS (SELECT pos, other FROM far, reach WHERE d <= reach),
"""


@query("hotspots_of_scattered_cells", parts=["stations"], sql=f"""
{_SCATTERED.strip()}
{permutation_sql("cells", "pairs", ("lisa", "getis_ord")).strip()}
SELECT method, latitude, longitude, ROUND(statistic, 5) AS statistic, ROUND(p_value, 6) AS p_value, significant, cluster_type
FROM classes JOIN cells USING (pos) WHERE (SELECT count(*) FROM cells) >= 30
""")
def hotspots_of_scattered_cells(spark, sf_dir):
    """Both statistics on places that form no grid, with 999 replicates."""
    cells = domain.stations(spark, sf_dir).select("latitude", "longitude", F.col("pm25").alias("PM2.5"))
    classes, _ = S.scattered_hotspots(cells)
    return classes.select("method", "latitude", "longitude", F.round("statistic", 5).alias("statistic"),
                          r6("p_value").alias("p_value"), "significant", "cluster_type")
