"""Named SQL building blocks of the check queries (DuckDB dialect).

They restate the domain mapping and the operators in SQL, independently of the
Spark code, so that both results can be compared.
"""

from __future__ import annotations

from collections.abc import Iterable

# name -> (needed parts, SQL)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, sql: str, *needs: str) -> None:
    PARTS[name] = (needs, sql.strip())


def with_parts(names: Iterable[str], body: str) -> str:
    """Prefix a statement with the parts it needs, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in PARTS[name][0]:
            visit(need)
        order.append(name)

    for name in names:
        visit(name)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS (\n{PARTS[n][1]}\n)" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:].strip()}"
    return f"WITH {ctes}\n{body}"


def aqi_sql(c: str) -> str:
    """National index of a concentration expression."""
    return f"""CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) OR {c} < 0 THEN NULL ELSE
    least(greatest(CASE
      WHEN {c} <= 30 THEN (50.0::DOUBLE / 30.0::DOUBLE) * ({c} - 0.0::DOUBLE) + 0.0::DOUBLE
      WHEN {c} <= 60 THEN (49.0::DOUBLE / 29.0::DOUBLE) * ({c} - 31.0::DOUBLE) + 51.0::DOUBLE
      WHEN {c} <= 90 THEN (99.0::DOUBLE / 29.0::DOUBLE) * ({c} - 61.0::DOUBLE) + 101.0::DOUBLE
      WHEN {c} <= 120 THEN (99.0::DOUBLE / 29.0::DOUBLE) * ({c} - 91.0::DOUBLE) + 201.0::DOUBLE
      WHEN {c} <= 250 THEN (99.0::DOUBLE / 129.0::DOUBLE) * ({c} - 121.0::DOUBLE) + 301.0::DOUBLE
      ELSE (99.0::DOUBLE / 100.0::DOUBLE) * ({c} - 250.0::DOUBLE) + 401.0::DOUBLE END,
      0.0::DOUBLE), 500.0::DOUBLE) END"""


def epa_sql(c: str) -> str:
    """US index of a concentration expression."""
    rows = [(0.0, 9.0, 0, 50), (9.1, 35.4, 51, 100), (35.5, 55.4, 101, 150),
            (55.5, 125.4, 151, 200), (125.5, 225.4, 201, 300), (225.5, 325.4, 301, 400)]
    arms = "\n".join(
        f"WHEN {c} <= {hi}::DOUBLE THEN (({b}::DOUBLE - {a}::DOUBLE) / ({hi}::DOUBLE - {lo}::DOUBLE))"
        f" * ({c} - {lo}::DOUBLE) + {a}::DOUBLE" for lo, hi, a, b in rows)
    return f"""CASE WHEN {c} IS NULL OR {c} < 0 THEN NULL ELSE least(greatest(CASE {arms}
      ELSE ((500::DOUBLE - 401::DOUBLE) / (500.4::DOUBLE - 325.5::DOUBLE))
        * ({c} - 325.5::DOUBLE) + 401::DOUBLE END, 0.0::DOUBLE), 500.0::DOUBLE) END"""


def category_sql(a: str) -> str:
    return f"""CASE WHEN {a} >= 401 THEN 'SEVERE' WHEN {a} >= 301 THEN 'VERY_POOR'
      WHEN {a} >= 201 THEN 'POOR' WHEN {a} >= 101 THEN 'MODERATELY_POLLUTED'
      WHEN {a} >= 51 THEN 'SATISFACTORY' WHEN {a} >= 0 THEN 'GOOD' END"""


def epa_category_sql(a: str) -> str:
    return f"""CASE WHEN {a} >= 301 THEN 'HAZARDOUS' WHEN {a} >= 201 THEN 'VERY_UNHEALTHY'
      WHEN {a} >= 151 THEN 'UNHEALTHY' WHEN {a} >= 101 THEN 'UNHEALTHY_SENSITIVE_GROUPS'
      WHEN {a} >= 51 THEN 'MODERATE' WHEN {a} >= 0 THEN 'GOOD' END"""


def permutation_sql(cells: str, pairs: str, methods: tuple[str, ...], replicates: int = 999, seed: int = 42) -> str:
    """CTEs that test numbered cells (pos, x) with neighbours (pos, other); the last is ``tested`` (method, pos, statistic, p_value).

    The permutation is restated from its definition: a Feistel network whose hash is a
    square modulo a prime, repeated for numbers past the end.
    """
    body = "SELECT rep, pos, step, n, a, b, y // b AS l, y % b AS r FROM walk, dims WHERE step = 0 OR y >= n"
    for k in range(6):
        one, other, size = ("l", "r", "a") if k % 2 else ("r", "l", "b")
        key = f"((rep * 1103515245 + {seed * 7919 + k * 104729}) % 2147483647)"
        body = f"SELECT *, ({key} + {other} * 40503767) % 2147483647 AS m FROM ({body})"
        body = f"SELECT rep, pos, step, n, a, b, {other}, ({one} + (m * m + {key}) % 2147483647) % {size} AS {one} FROM ({body})"
    lisa = "CASE WHEN w > 0 THEN (v - mu) / (sd + 1e-10::DOUBLE) * ((s - w * mu) / (sd + 1e-10::DOUBLE)) / w ELSE 0.0::DOUBLE END"
    spread = "sd * sqrt((n * w - w * w) / (n - 1)::DOUBLE{})"
    gi = f"CASE WHEN {spread.format('')} < 1e-10 THEN 0.0::DOUBLE ELSE (s - mu * w) / ({spread.format('')}) END"
    again = f"CASE WHEN sd < 1e-10 THEN 0.0::DOUBLE ELSE (s - mu * w) / ({spread.format(' + 1e-10::DOUBLE')}) END"
    tested = "\nUNION ALL\n".join(f"""SELECT '{m}' AS method, o.pos, any_value(o.o) AS statistic,
  (count(*) FILTER (abs({lisa if m == 'lisa' else again}) >= abs(o.o) - 1e-9::DOUBLE) + 1) / {replicates + 1}.0::DOUBLE AS p_value
FROM moved_sums s JOIN moments ON TRUE JOIN (SELECT pos, {lisa if m == 'lisa' else gi} AS o FROM own_sums, moments) o ON o.pos = s.pos GROUP BY o.pos""" for m in methods)
    return f"""
moments AS (SELECT count(*) AS n, avg(x) AS mu, stddev_samp(x) AS sd FROM {cells}),
dims AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM moments)),
walk AS (
  SELECT range AS rep, pos, pos AS y, 0 AS step FROM {cells}, range({replicates})
  UNION ALL
  SELECT rep, pos, l * b + r AS y, step + 1 FROM ({body})),
moved AS (SELECT rep, y AS pos, c.x AS v FROM walk JOIN {cells} c USING (pos), dims WHERE step > 0 AND y < dims.n),
moved_sums AS (
  SELECT m.rep, m.pos, any_value(m.v) AS v, count(o.v) AS w, coalesce(sum(o.v), 0.0::DOUBLE) AS s FROM moved m
  LEFT JOIN {pairs} p ON p.pos = m.pos LEFT JOIN moved o ON o.rep = m.rep AND o.pos = p.other GROUP BY m.rep, m.pos),
own_sums AS (
  SELECT c.pos, any_value(c.x) AS v, count(o.x) AS w, coalesce(sum(o.x), 0.0::DOUBLE) AS s FROM {cells} c
  LEFT JOIN {pairs} p ON p.pos = c.pos LEFT JOIN {cells} o ON o.pos = p.other GROUP BY c.pos),
tested AS ({tested}),
ranked AS (SELECT *, count(*) OVER (PARTITION BY method ORDER BY p_value) AS k, count(*) OVER (PARTITION BY method) AS m FROM tested),
cuts AS (SELECT method, max(p_value) FILTER (p_value <= 0.05::DOUBLE * k / m) AS cut FROM ranked GROUP BY method),
classes AS (
  SELECT tested.*, coalesce(p_value <= cut, FALSE) AS significant, CASE WHEN p_value <= cut AND statistic > 0 THEN 'HOTSPOT'
    WHEN p_value <= cut AND statistic < 0 THEN 'COLDSPOT' ELSE 'NOT_SIGNIFICANT' END AS cluster_type
  FROM tested JOIN cuts USING (method))"""


part("obs", """
SELECT event_id * 2 + copy AS ordinal, 'S' || user_id AS station_id, event_type AS source,
  n_name AS country,
  CASE WHEN event_id % 101 = 0 THEN 91.0::DOUBLE
       ELSE 28.4::DOUBLE + (user_id * 7 % 401) / 1000.0::DOUBLE END AS latitude,
  77.0::DOUBLE + (user_id * 13 % 409) / 1000.0::DOUBLE AS longitude,
  CASE WHEN event_id % 109 <> 0 THEN ts END AS timestamp,
  CASE WHEN event_id % 103 = 0 THEN NULL WHEN event_id % 97 = 0 THEN -v - 1.0::DOUBLE ELSE v END AS pm,
  CASE WHEN event_id % 107 = 0 THEN NULL WHEN k <= 3 THEN 'ug/m3' WHEN k <= 5 THEN 'μg/m³'
       WHEN k = 6 THEN ' UG/m^3 ' WHEN k = 7 THEN 'mg/m3' WHEN k = 8 THEN 'ng/m3'
       ELSE 'ppm' END AS units
FROM (
  SELECT *, CASE WHEN k = 7 THEN (value + copy) / 1000.0::DOUBLE
                 WHEN k = 8 THEN (value + copy) * 1000.0::DOUBLE ELSE value + copy END AS v
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS k FROM events) e
  CROSS JOIN (VALUES (0), (1)) c(copy)
  WHERE copy = 0 OR event_id % 89 = 0
) x LEFT JOIN nation ON n_nationkey = user_id % 25
""")
part("obs_u", """
SELECT *, pm * CASE
  replace(replace(replace(replace(lower(trim(units)), '^', ''), '³', '3'), 'μ', 'µ'), 'µg', 'ug')
  WHEN 'ug/m3' THEN 1.0::DOUBLE WHEN 'mg/m3' THEN 1000.0::DOUBLE WHEN 'ng/m3' THEN 0.001::DOUBLE
  END AS pm25_ug_m3
FROM obs
""", "obs")
part("obs_first", """
SELECT * FROM (
  SELECT *, count(*) OVER k AS n_rows, row_number() OVER (k ORDER BY ordinal) AS rn
  FROM obs_u WINDOW k AS (PARTITION BY station_id, timestamp)) z
WHERE rn = 1
""", "obs_u")
part("obs_checked", """
SELECT *, CASE
  WHEN NOT (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180) THEN 'invalid_coordinates'
  WHEN timestamp IS NULL THEN 'invalid_timestamps'
  WHEN units IS NULL OR units = '' THEN 'invalid_units'
  WHEN pm25_ug_m3 IS NULL THEN 'missing_pm25'
  WHEN pm25_ug_m3 < 0 THEN 'negative_pm25'
  WHEN pm25_ug_m3 > 1000 THEN 'above_max_pm25' END AS reject_reason
FROM obs_first
""", "obs_first")
part("clean", "SELECT * FROM obs_checked WHERE reject_reason IS NULL", "obs_checked")
part("daily", """
SELECT station_id, CAST(timestamp AS DATE) AS date, avg(pm25_ug_m3) AS pm25_daily,
  count(*) AS observation_count, arg_min(latitude, ordinal) AS latitude,
  arg_min(longitude, ordinal) AS longitude, arg_min(country, ordinal) AS country,
  arg_min(source, ordinal) AS source
FROM clean GROUP BY 1, 2
""", "clean")
part("stations", """
SELECT station_id, arg_min(latitude, ordinal) AS latitude, arg_min(longitude, ordinal) AS longitude,
  avg(pm25_ug_m3) AS pm25, max(pm25_ug_m3) AS peak
FROM clean GROUP BY 1
""", "clean")
part("cell_days", """
SELECT *, sqrt(u * u + v * v) AS wind_speed_mps,
  CASE WHEN 270.0::DOUBLE - degrees(atan2(v, u)) >= 360 THEN 270.0::DOUBLE - degrees(atan2(v, u)) - 360.0::DOUBLE
       ELSE 270.0::DOUBLE - degrees(atan2(v, u)) END AS wind_direction_deg
FROM (
  SELECT l_suppkey % 9 AS cell_row, l_partkey % 9 AS cell_col,
    DATE '2024-01-01' + CAST(l_orderkey % 30 AS INT) AS date,
    avg(CASE WHEN l_linenumber <= 2 THEN l_discount * 10.0::DOUBLE END) AS "AOD",
    avg(l_quantity - 5.0::DOUBLE) AS temperature_c,
    avg(l_tax * 1000.0::DOUBLE + 20.0::DOUBLE) AS relative_humidity_pct,
    avg(l_discount * 100.0::DOUBLE - 5.0::DOUBLE) AS u, avg(l_tax * 100.0::DOUBLE - 4.0::DOUBLE) AS v,
    avg(CASE WHEN l_linenumber <= 3 THEN l_discount * l_quantity / 5.0::DOUBLE END) AS "NDVI",
    avg(l_extendedprice / 1000.0::DOUBLE) AS night_lights
  FROM lineitem GROUP BY 1, 2, 3) g
""")
part("cell_static", """
SELECT l_suppkey % 9 AS cell_row, l_partkey % 9 AS cell_col,
  avg(l_quantity * 10.0::DOUBLE) AS elevation_m, count(*) / 25.0::DOUBLE AS road_density
FROM lineitem GROUP BY 1, 2
""")
part("features_1km", "SELECT * FROM cell_days JOIN cell_static USING (cell_row, cell_col)",
     "cell_days", "cell_static")
part("training", """
SELECT *,
  "PM2.5" IS NOT NULL AND "AOD" IS NOT NULL AND temperature_c IS NOT NULL
    AND relative_humidity_pct IS NOT NULL AND wind_speed_mps IS NOT NULL
    AND wind_direction_deg IS NOT NULL AND "NDVI" IS NOT NULL AND elevation_m IS NOT NULL
    AND road_density IS NOT NULL AND night_lights IS NOT NULL AS complete_case,
  CAST("AOD" IS NOT NULL AS INT) + CAST(temperature_c IS NOT NULL AS INT)
    + CAST(relative_humidity_pct IS NOT NULL AS INT) + CAST(wind_speed_mps IS NOT NULL AS INT)
    + CAST(wind_direction_deg IS NOT NULL AS INT) + CAST("NDVI" IS NOT NULL AS INT)
    + CAST(elevation_m IS NOT NULL AS INT) + CAST(road_density IS NOT NULL AS INT)
    + CAST(night_lights IS NOT NULL AS INT) + CAST(wind_u_mps IS NOT NULL AS INT)
    + CAST(wind_v_mps IS NOT NULL AS INT) AS n_features_available
FROM (
  SELECT d.station_id, d.country, d.latitude, d.longitude, d.date, d.pm25_daily AS "PM2.5",
    f."AOD", f.temperature_c, f.relative_humidity_pct, f.wind_speed_mps, f.wind_direction_deg,
    f."NDVI", f.elevation_m, f.road_density, f.night_lights,
    -f.wind_speed_mps * sin(radians(f.wind_direction_deg)) AS wind_u_mps,
    -f.wind_speed_mps * cos(radians(f.wind_direction_deg)) AS wind_v_mps,
    CAST(month(d.date) AS DOUBLE) AS month, CAST(dayofyear(d.date) AS DOUBLE) AS day_of_year,
    sin(CAST(dayofyear(d.date) AS DOUBLE) * (2.0::DOUBLE * pi()) / 365.25::DOUBLE) AS sin_day_of_year,
    cos(CAST(dayofyear(d.date) AS DOUBLE) * (2.0::DOUBLE * pi()) / 365.25::DOUBLE) AS cos_day_of_year
  FROM daily d LEFT JOIN features_1km f
    ON f.cell_row = CAST(floor((d.latitude - 28.4::DOUBLE) / 0.05::DOUBLE) AS BIGINT)
   AND f.cell_col = CAST(floor((d.longitude - 77.0::DOUBLE) / 0.05::DOUBLE) AS BIGINT)
   AND f.date = d.date) t
""", "daily", "features_1km")
part("pixels", """
SELECT l_orderkey // 64 AS row, l_partkey % 64 AS col, l_quantity AS value, l_linenumber - 1 AS qa,
  l_discount AS discount, l_extendedprice AS price, CAST(l_shipdate AS DATE) AS obs_date
FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey // 64, l_partkey % 64
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) z
WHERE rn = 1
""")
part("weather", """
SELECT l_shipdate + to_hours(CAST(l_linenumber * 3 AS INT)) AS time,
  28.4::DOUBLE + (l_suppkey % 5) / 10.0::DOUBLE AS latitude,
  77.0::DOUBLE + (l_partkey % 5) / 10.0::DOUBLE AS longitude,
  CASE WHEN dayofyear(l_shipdate) % 50 <> 0 THEN 263.15::DOUBLE + l_quantity END AS temperature_k,
  CASE WHEN dayofyear(l_shipdate) % 50 <> 0 THEN 263.15::DOUBLE + l_quantity - 273.15::DOUBLE END AS temperature,
  CASE WHEN l_orderkey % 53 <> 0 THEN l_tax * 1100.0::DOUBLE + 15.0::DOUBLE END AS relative_humidity,
  (l_discount * 100.0::DOUBLE - 5.0::DOUBLE) * 10.0::DOUBLE AS u_wind,
  (l_tax * 100.0::DOUBLE - 4.0::DOUBLE) * 10.0::DOUBLE AS v_wind,
  l_suppkey % 5 AS row, l_partkey % 5 AS col
FROM lineitem
""")
part("roads", """
SELECT l_orderkey * 8 + l_linenumber AS road_id,
  CASE WHEN l_orderkey % 67 <> 0 THEN CASE l_returnflag WHEN 'A' THEN 'primary'
    WHEN 'R' THEN 'secondary' ELSE 'residential' END END AS highway,
  CASE WHEN l_orderkey % 71 = 0 THEN 1 WHEN l_orderkey % 61 <> 0 THEN 3 END AS n_points,
  x1, y1, x2, y2, x2 + (l_tax * 100.0::DOUBLE - 3.5::DOUBLE) * 200.0::DOUBLE AS x3,
  y2 + 700.0::DOUBLE AS y3
FROM (
  SELECT *, x1 + (l_quantity - 25.5::DOUBLE) * 60.0::DOUBLE AS x2,
    y1 + (l_discount * 100.0::DOUBLE - 5.5::DOUBLE) * 150.0::DOUBLE AS y2
  FROM (SELECT *, (l_partkey * 37 % 40000) + 0.5::DOUBLE AS x1,
          (l_orderkey * 41 % 40000) + 0.25::DOUBLE AS y1 FROM lineitem) a) b
""")
part("log", """
SELECT (['pm25','aod','weather','ndvi','dem','osm','viirs'])[CAST(o_custkey % 7 + 1 AS INT)] AS source,
  'tile_' || (o_custkey % 36) AS tile_id,
  CASE WHEN o_custkey % 7 IN (4, 2) THEN 'ok' WHEN o_custkey % 7 = 6 THEN 'failed'
       WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'ok' END AS outcome,
  CAST(o_orderdate AS DATE) + CAST(o_custkey % 7 * 20 AS INT) AS fetched_at,
  CASE WHEN o_custkey % 7 <> 2 THEN o_orderpriority END AS checksum
FROM orders
""")
