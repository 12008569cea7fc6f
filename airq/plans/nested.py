"""Queries on nested provider pages and the acquisition log."""

from __future__ import annotations

from pyspark.sql import functions as F

from airq.functions.status import FRESHNESS_WINDOW_S, ready_for_training
from airq.operators import source_status as S
from airq.plans.registry import query, r6, stamp
from airq.sources import domain, nested

#: When the log is read, some days after the last order of the tables.
_READ_AT = "2001-08-25 00:00:00"
BOUNDS = (-150.0, -60.0, 160.0, 75.0)


@query("flatten_locations", sql="""
WITH loc AS (
  SELECT o_orderkey AS page, 0 AS pos, o_custkey AS id,
    (o_custkey % 180)::DOUBLE - 85.0::DOUBLE AS lat, (o_custkey * 7 % 360)::DOUBLE - 180.0::DOUBLE AS lon,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 10 + 2 ELSE o_orderkey * 10 END AS sensor,
    o_custkey % 25 AS cc FROM orders
  UNION ALL
  SELECT o_orderkey, 1, o_custkey + 1000000000, CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey % 80)::DOUBLE END,
    (o_custkey % 170)::DOUBLE, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 10 + 3 END, o_custkey % 25 FROM orders),
first AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY page, pos) AS rn FROM loc
  WHERE lon BETWEEN -150 AND 160 AND lat BETWEEN -60 AND 75)
SELECT id AS location_id, 'L' || id AS name, lat AS latitude, lon AS longitude,
  CAST(cc AS VARCHAR) AS country, sensor AS sensor_id
FROM first WHERE rn = 1 AND sensor IS NOT NULL
""")
def flatten_locations(spark, sf_dir):
    return nested.flatten_locations(domain.location_pages(spark, sf_dir), BOUNDS, "page")


@query("flatten_sensor_days", sql="""
SELECT CAST(o_custkey AS VARCHAR) AS station_id, 'openaq' AS source,
  strftime(CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END, '%Y-%m-%d %H:%M:%S') AS timestamp,
  ROUND(o_totalprice / 1000.0::DOUBLE, 6) AS pm25, 'ug/m3' AS units
FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 8 <> 0
UNION ALL
SELECT CAST(o_custkey AS VARCHAR), 'openaq', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'),
  ROUND(o_totalprice / 2000.0::DOUBLE, 6), 'mg/m3' FROM orders
""")
def flatten_sensor_days(spark, sf_dir):
    o = domain.table(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    t0 = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    t1 = F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def entry(value, unit, start, end):
        return F.struct(value.alias("value"), unit.alias("unit"), F.struct(
            F.struct(start.alias("utc")).alias("datetimeFrom"),
            F.struct(end.alias("utc")).alias("datetimeTo")).alias("period"))

    price = F.col("o_totalprice") / 1000.0
    value = F.when(ok % 3 == 0, -price - 1.0).otherwise(price)
    start = F.when(ok % 4 != 0, t0)
    pages = o.select(
        F.col("o_custkey").alias("location_id"), F.lit(28.5).alias("latitude"),
        F.lit(77.1).alias("longitude"), F.lit("IN").alias("country"),
        F.array(entry(value, F.lit(""), start, F.when(ok % 8 != 0, t1)),
                entry(F.col("o_totalprice") / 2000.0, F.lit("mg/m3"), t0, t1)).alias("results"))
    return nested.flatten_sensor_days(pages).select(
        "station_id", "source", stamp("timestamp", "timestamp"), r6("`PM2.5`").alias("pm25"), "units")


AS_OF = "2001-12-31 00:00:00"

_STATUS_SQL = """
t AS (SELECT source, count(*) FILTER (outcome = 'ok') AS tiles_completed,
  count(*) FILTER (outcome = 'failed') AS tiles_failed, max(fetched_at) FILTER (outcome = 'ok') AS last_fetch,
  count(checksum) FILTER (outcome = 'ok') AS n_checksums FROM log GROUP BY 1),
w AS (SELECT *, CASE source WHEN 'pm25' THEN 604800 WHEN 'weather' THEN 7776000 WHEN 'ndvi' THEN 2764800
    WHEN 'dem' THEN 31536000 ELSE 2592000 END AS window_s,
  ROUND(epoch(TIMESTAMP '2001-12-31' - CAST(last_fetch AS TIMESTAMP)), 1)::DOUBLE AS age_s FROM t),
f AS (SELECT *, coalesce(age_s <= window_s, FALSE) AS fresh FROM w),
s AS (SELECT *, CASE WHEN tiles_completed = 0 THEN 'UNAVAILABLE' WHEN tiles_failed > 0 THEN 'PARTIAL'
  WHEN NOT fresh THEN 'STALE' ELSE 'AVAILABLE' END AS status FROM f)
"""


def _status(spark, sf_dir):
    return S.source_status(domain.acquisition_log(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))


@query("source_status", parts=["log"], sql=f"""
WITH {_STATUS_SQL}
SELECT source, tiles_completed, tiles_failed, n_checksums, fresh, status,
  CASE WHEN last_fetch IS NULL THEN 'never_fetched'
    WHEN NOT fresh THEN 'age_' || CAST(age_s AS BIGINT) || 's_exceeds_window_' || window_s || 's' END AS stale_reason,
  CASE WHEN status = 'UNAVAILABLE' THEN 'NONE' WHEN status = 'STALE' THEN 'LOW' WHEN status = 'PARTIAL' THEN 'MEDIUM'
    WHEN n_checksums = 0 THEN 'LOW' ELSE 'HIGH' END AS confidence,
  status = 'AVAILABLE' AND n_checksums > 0 AS ready
FROM s
""")
def source_status(spark, sf_dir):
    return _status(spark, sf_dir).select(
        "source", "tiles_completed", "tiles_failed", "n_checksums", "fresh", "status", "stale_reason",
        "confidence", ready_for_training(F.col("status"), F.col("confidence")).alias("ready"))


@query("overall_source_status", parts=["log"], sql=f"""
WITH {_STATUS_SQL}
SELECT arg_max(status, CASE status WHEN 'AVAILABLE' THEN 0 WHEN 'PARTIAL' THEN 1 WHEN 'STALE' THEN 2
    WHEN 'UNAVAILABLE' THEN 3 ELSE 4 END) AS overall,
  count(*) FILTER (status = 'AVAILABLE') AS available_sources, count(*) FILTER (status = 'STALE') AS stale_sources,
  count(*) FILTER (status IN ('UNAVAILABLE', 'FAILED')) AS unavailable_sources, count(*) AS total_sources
FROM s
""")
def overall_source_status(spark, sf_dir):
    return S.overall_status(_status(spark, sf_dir))


@query("freshness_report", sql=f"""
WITH a AS (
  SELECT CASE o_orderkey % 3 WHEN 0 THEN 'pm25' WHEN 1 THEN 'weather' ELSE 'osm' END AS source,
    CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(o_orderkey % 86400 AS INT)) AS modified,
    CASE WHEN o_orderkey % 3 = 1 THEN 0::BIGINT ELSE o_orderkey * 10 END AS length FROM orders),
n AS (SELECT source, max(modified) AS modified, max(length) FILTER (modified = m) AS size_bytes
  FROM (SELECT *, max(modified) OVER (PARTITION BY source) AS m FROM a) x GROUP BY 1),
t AS (SELECT *, epoch_us(TIMESTAMP '{_READ_AT}' - modified) / 1e6 AS age,
    CASE source {' '.join(f"WHEN '{k}' THEN {FRESHNESS_WINDOW_S[k]}" for k in ('pm25', 'weather', 'osm'))} END::BIGINT AS window_s FROM n)
SELECT source, size_bytes > 0 AS present, size_bytes > 0 AND age <= window_s AS fresh, ROUND(age, 1) AS age_s, window_s, size_bytes FROM t
""")
def freshness_report(spark, sf_dir):
    """Orders as an acquisition log: one source has no data in its newest file."""
    key = F.col("o_orderkey")
    log = domain.table(spark, sf_dir, "orders").select(
        F.when(key % 3 == 0, "pm25").when(key % 3 == 1, "weather").otherwise("osm").alias("source"),
        F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + key % 86400).alias("modified"),
        F.when(key % 3 == 1, F.lit(0).cast("bigint")).otherwise(key * 10).alias("length"))
    return S.freshness_report(log, F.lit(_READ_AT).cast("timestamp"))
