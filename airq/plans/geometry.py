"""Queries on geodesic distances and on joins with polygons and rectangles that are tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from airq.functions.geodesic import (FLATTENING, HALVINGS, LENGTH_SERIES, POLAR, RADIUS, SECOND, THIRD, TINY, geodesic_km,
                                     longitude_series)
from airq.operators import nearest as N, regions as R
from airq.plans.registry import query
from airq.plans.sql_parts import part
from airq.session import new_shared_path
from airq.sources import domain

# ------------------------------------------------------------------ positions


def _at(key: str, lat: int, lon: int) -> list[Column]:
    k = F.col(key)
    return [((k * lat % 17001).cast("double") / 100.0 - 85.0).alias("latitude"), ((k * lon % 36000).cast("double") / 100.0 - 180.0).alias("longitude")]


def _customers(spark, sf_dir):
    return domain.table(spark, sf_dir, "customer").select("c_custkey", *_at("c_custkey", 37, 91))


def _suppliers(spark, sf_dir):
    return domain.table(spark, sf_dir, "supplier").select("s_suppkey", *_at("s_suppkey", 53, 29))


part("customer_at", """SELECT c_custkey, (c_custkey * 37 % 17001)::DOUBLE / 100.0::DOUBLE - 85.0::DOUBLE AS latitude,
  (c_custkey * 91 % 36000)::DOUBLE / 100.0::DOUBLE - 180.0::DOUBLE AS longitude FROM customer""")
part("supplier_at", """SELECT s_suppkey, (s_suppkey * 53 % 17001)::DOUBLE / 100.0::DOUBLE - 85.0::DOUBLE AS latitude,
  (s_suppkey * 29 % 36000)::DOUBLE / 100.0::DOUBLE - 180.0::DOUBLE AS longitude FROM supplier""")


def _series(coefficients: list[float], constant: float = 0.0) -> str:
    out = "0.0::DOUBLE"
    for c in reversed(coefficients):
        out = f"(({out} + ({float(c)!r})::DOUBLE) * e)"
    return f"({out} + ({constant!r})::DOUBLE)"


def _sines(rows: list[list[float]]) -> str:
    return "(s2 - s1) + " + " + ".join(f"{_series(c)} * (sin({2 * l} * s2) - sin({2 * l} * s1))" for l, c in enumerate(rows, start=1))


_SCALE, _LONGITUDE = longitude_series(THIRD)
_ARC = f"""SELECT *, atan2(sin1, c1 * cos1) AS s1, atan2(sin2, c2 * cos2) AS s2, atan2(a0 * sin2, c2 * cos2) - atan2(a0 * sin1, c1 * cos1) AS w,
    k / (2 * (1 + sqrt(1 + k)) + k) AS e FROM (
  SELECT *, {SECOND!r}::DOUBLE * (1 - a0 * a0) AS k FROM (
    SELECT *, sin(m) * cos1 AS a0, cos(m) AS c1, sqrt(greatest(cos(m) * cos(m) * cos1 * cos1 + (sin1 - sin2) * (sin1 + sin2), 0.0::DOUBLE)) / cos2 AS c2 FROM (
      SELECT *, (low + high) / 2 AS m FROM walk WHERE {{}})))"""


@query("geodesic_distances", parts=["customer_at", "supplier_at"], sql=f"""
WITH RECURSIVE h AS (
  SELECT c.c_custkey, s.s_suppkey, c.latitude AS lat1, c.longitude AS lon1, s.latitude AS lat2, s.longitude AS lon2, asin(least(1.0::DOUBLE, sqrt(
    power(sin((radians(s.latitude) - radians(c.latitude)) / 2), 2) + cos(radians(c.latitude)) * cos(radians(s.latitude))
    * power(sin((radians(s.longitude) - radians(c.longitude)) / 2), 2)))) AS d FROM customer_at c, supplier_at s),
ends AS (
  SELECT 'nearest supplier' AS leg, c_custkey, arg_min(s_suppkey, (d, s_suppkey)) AS s_suppkey, any_value(lat1) AS lat1, any_value(lon1) AS lon1,
    arg_min(lat2, (d, s_suppkey)) AS lat2, arg_min(lon2, (d, s_suppkey)) AS lon2 FROM h GROUP BY c_custkey
  UNION ALL
  SELECT 'antipode', c_custkey, NULL, latitude, longitude, -latitude + (c_custkey % 3) / 10.0::DOUBLE, longitude + 180.0::DOUBLE - (c_custkey % 2) / 5.0::DOUBLE FROM customer_at),
canon AS (
  SELECT *, abs(((lon2 - lon1 + 180.0::DOUBLE) % 360.0::DOUBLE + 360.0::DOUBLE) % 360.0::DOUBLE - 180.0::DOUBLE) AS turn,
    CASE WHEN abs(lat1) < abs(lat2) THEN lat2 ELSE lat1 END AS far, CASE WHEN abs(lat1) < abs(lat2) THEN lat1 ELSE lat2 END AS near FROM ends),
signed AS (SELECT *, CASE WHEN far > 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign FROM canon),
u AS (SELECT *, atan({1 - FLATTENING!r}::DOUBLE * tan(radians(sign * far))) AS u1, atan({1 - FLATTENING!r}::DOUBLE * tan(radians(sign * near))) AS u2 FROM signed),
walk AS (
  SELECT leg, c_custkey, s_suppkey, lat1, lat2, turn, least(sin(u1), -{TINY!r}::DOUBLE) AS sin1, greatest(cos(u1), {TINY!r}::DOUBLE) AS cos1,
    sin(u2) AS sin2, greatest(cos(u2), {TINY!r}::DOUBLE) AS cos2, 0.0::DOUBLE AS low, pi() AS high, 0 AS step FROM u
  UNION ALL
  SELECT leg, c_custkey, s_suppkey, lat1, lat2, turn, sin1, cos1, sin2, cos2, CASE WHEN short THEN m ELSE low END, CASE WHEN short THEN high ELSE m END, step + 1
  FROM (SELECT *, w - {FLATTENING!r}::DOUBLE * a0 * {_series(_SCALE[1:], 1.0)} * ({_sines(_LONGITUDE)}) < radians(turn) AS short
    FROM ({_ARC.format(f'step < {HALVINGS}')}))),
length AS (
  SELECT *, {POLAR!r}::DOUBLE * (1 + e * e / 4 + power(e, 4) / 64 + power(e, 6) / 256) / (1 - e) * ({_sines(LENGTH_SERIES)}) AS metres
  FROM ({_ARC.format(f'step = {HALVINGS}')}))
SELECT leg, c_custkey, s_suppkey, ROUND(CASE WHEN lat1 = 0 AND lat2 = 0 AND turn <= {180.0 * (1 - FLATTENING)!r}::DOUBLE
  THEN radians(turn) * {RADIUS!r}::DOUBLE ELSE metres END / 1000, 6) AS distance_km FROM length
""")
def geodesic_distances(spark, sf_dir):
    """Every customer to the nearest supplier and to a point at or close to the antipode."""
    customers, suppliers = _customers(spark, sf_dir), _suppliers(spark, sf_dir)
    near = N.nearest_station(customers, suppliers, "c_custkey", "s_suppkey").select("c_custkey", "s_suppkey")
    there = suppliers.select("s_suppkey", F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"))
    near = customers.join(near, "c_custkey").join(there, "s_suppkey").select(F.lit("nearest supplier").alias("leg"), "c_custkey", "s_suppkey", "latitude", "longitude", "lat2", "lon2")
    k = F.col("c_custkey")
    far = customers.select(F.lit("antipode").alias("leg"), "c_custkey", F.lit(None).cast("long").alias("s_suppkey"), "latitude", "longitude",
                           (-F.col("latitude") + (k % 3) / 10.0).alias("lat2"), (F.col("longitude") + 180.0 - (k % 2) / 5.0).alias("lon2"))
    # Half a millisecond a row: tasks are dealt by rows, as the few bytes of the table would make few tasks.
    tasks = max(spark.sparkContext.defaultParallelism, min(8192, 2 * customers.count() // 5000))
    legs = near.withColumn("s_suppkey", F.col("s_suppkey").cast("long")).unionByName(far).repartition(tasks)
    km = geodesic_km(F.col("latitude"), F.col("longitude"), F.col("lat2"), F.col("lon2"))
    return legs.select("leg", "c_custkey", "s_suppkey", F.round(km, 6).alias("distance_km"))


# ------------------------------------------------------------------- polygons

#: Corners of a shape around its middle, in units of its radius: a notched outline and a hole.
_OUTLINE = [(1.0, 0.0), (0.25, 0.375), (0.0, 1.0), (-0.375, 0.25), (-1.0, 0.0), (-0.25, -0.375), (0.0, -1.0), (0.375, -0.25)]
_HOLE = [(0.125, 0.125), (-0.125, 0.125), (-0.125, -0.125), (0.125, -0.125)]


def _regions(spark, sf_dir):
    """A notched shape with a hole around each supplier, small and large, and two triangles that share a border."""
    s = _suppliers(spark, sf_dir)
    k, x, y = F.col("s_suppkey"), F.col("longitude"), F.col("latitude")
    radius = F.pow(F.lit(2.0), (k % 7).cast("double"))

    def ring(corners):
        return F.array(*[F.struct((x + radius * dx).alias("x"), (y + radius * dy).alias("y")) for dx, dy in corners])

    star = s.select(F.concat(F.lit("star "), k.cast("string")).alias("region"), F.array(ring(_OUTLINE), ring(_HOLE)).alias("rings"))
    west, south = F.floor(x / 8.0) * 8.0, F.floor(y / 8.0) * 8.0
    corner = lambda dx, dy: F.struct((F.col("west") + dx).alias("x"), (F.col("south") + dy).alias("y"))
    square = s.select(west.cast("double").alias("west"), south.cast("double").alias("south")).distinct()
    half = lambda name, *c: square.select(F.concat_ws(" ", F.lit(name), F.col("west").cast("long").cast("string"), F.col("south").cast("long").cast("string")).alias("region"),
                                          F.array(F.array(*c)).alias("rings"))
    return star.unionByName(half("lower", corner(0.0, 0.0), corner(8.0, 0.0), corner(8.0, 8.0))).unionByName(
        half("upper", corner(0.0, 0.0), corner(8.0, 8.0), corner(0.0, 8.0), corner(0.0, 0.0)))


def _corners_sql(corners, x, y, r) -> str:
    return "[" + ", ".join(f"{{'x': {x} + {r} * ({dx!r})::DOUBLE, 'y': {y} + {r} * ({dy!r})::DOUBLE}}" for dx, dy in corners) + "]"


_STAR = [_corners_sql(c, "longitude", "latitude", "power(2.0::DOUBLE, s_suppkey % 7)") for c in (_OUTLINE, _HOLE)]
_HALF = [_corners_sql(c, "west", "south", "8.0::DOUBLE") for c in ([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 1.0), (0.0, 1.0)])]


@query("points_in_regions", parts=["customer_at", "supplier_at"], sql=f"""
WITH square AS (SELECT DISTINCT floor(longitude / 8.0::DOUBLE) * 8.0::DOUBLE AS west, floor(latitude / 8.0::DOUBLE) * 8.0::DOUBLE AS south FROM supplier_at),
ring AS (
  SELECT 'star ' || s_suppkey AS region, unnest([{_STAR[0]}, {_STAR[1]}]) AS ring FROM supplier_at
  UNION ALL SELECT 'lower ' || west::BIGINT || ' ' || south::BIGINT, {_HALF[0]} FROM square
  UNION ALL SELECT 'upper ' || west::BIGINT || ' ' || south::BIGINT, {_HALF[1]} FROM square),
edge AS (SELECT region, ring[i] AS a, ring[i % len(ring) + 1] AS b FROM (SELECT region, ring, unnest(range(1, len(ring) + 1)) AS i FROM ring)),
turned AS (
  SELECT c_custkey, region, a, b, longitude AS x, latitude AS y, (longitude - a.x) * (b.y - a.y) - (latitude - a.y) * (b.x - a.x) AS turn FROM customer_at, edge),
met AS (
  SELECT c_custkey, region, count(*) FILTER ((a.y > y) <> (b.y > y) AND CASE WHEN b.y > a.y THEN turn < 0 ELSE turn > 0 END) AS crossings,
    bool_or(turn = 0 AND x BETWEEN least(a.x, b.x) AND greatest(a.x, b.x) AND y BETWEEN least(a.y, b.y) AND greatest(a.y, b.y)) AS on_edge
  FROM turned GROUP BY c_custkey, region)
SELECT c_custkey, region FROM met WHERE crossings % 2 = 1 AND NOT on_edge
""")
def points_in_regions(spark, sf_dir):
    """Customers in the regions around suppliers."""
    return R.points_in_polygons(_customers(spark, sf_dir), "c_custkey", "longitude", "latitude", _regions(spark, sf_dir), "region", "rings")


# ----------------------------------------------------------------- rectangles


@query("tiles_of_areas", parts=["customer_at", "supplier_at"], sql="""
WITH tile AS (SELECT 'tile_' || s_suppkey AS tile_id, longitude AS west, latitude AS south, longitude + power(2.0::DOUBLE, s_suppkey % 8 - 1) AS east,
    latitude + power(2.0::DOUBLE, s_suppkey % 5) AS north FROM supplier_at WHERE s_suppkey % 10 <> 9),
area AS (SELECT c_custkey, floor(longitude) AS west, floor(latitude) AS south, floor(longitude) + 0.25::DOUBLE * (c_custkey % 20) AS east,
    floor(latitude) + 0.5::DOUBLE * (c_custkey % 9 + 1) AS north FROM customer_at)
SELECT tile_id, c_custkey FROM tile t JOIN area a ON t.west < a.east AND a.west < t.east AND t.south < a.north AND a.south < t.north
WHERE a.west < a.east
""")
def tiles_of_areas(spark, sf_dir):
    """A stored index of tiles of many sizes against areas of customers; some boxes are empty, a few are not boxes."""
    k, x, y = F.col("s_suppkey"), F.col("longitude"), F.col("latitude")
    tiles = _suppliers(spark, sf_dir).select(
        F.concat(F.lit("tile_"), k.cast("string")).alias("tile_id"), x.alias("west"), y.alias("south"),
        F.when(k % 10 != 9, x + F.pow(F.lit(2.0), (k % 8 - 1).cast("double"))).alias("east"), (y + F.pow(F.lit(2.0), (k % 5).cast("double"))).alias("north"))
    path = new_shared_path(spark, "tile-index")
    tiles.write.parquet(path)
    c = F.col("c_custkey")
    west, south = F.floor("longitude").cast("double"), F.floor("latitude").cast("double")
    areas = _customers(spark, sf_dir).select("c_custkey", west.alias("west"), south.alias("south"), (west + (c % 20) * 0.25).alias("east"), (south + (c % 9 + 1) * 0.5).alias("north"))
    return R.boxes_intersecting(R.read_tile_index(spark, path), "tile_id", areas, "c_custkey")
