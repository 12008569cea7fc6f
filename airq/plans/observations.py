"""Queries on observations: units, quality, daily series, registries, index."""

from __future__ import annotations

from pyspark.sql import functions as F

from airq.functions import aqi, geo, units
from airq.operators import daily as D, qc, source_status as S
from airq.operators.dedupe import latest
from airq.plans.registry import day, query, r6, rounded, stamp
from airq.plans.sql_parts import aqi_sql, category_sql, epa_category_sql, epa_sql
from airq.session import materialize
from airq.sources import domain
from airq.sources.readers import coerce_timestamp, union_ground_truth


@query("aqi_by_country", parts=["daily"], sql=f"""
SELECT country, category, count(*) AS station_days, ROUND(avg(aqi), 6) AS mean_aqi,
  ROUND(max(pm25_daily), 6) AS max_pm25
FROM (SELECT *, {category_sql('aqi')} AS category
      FROM (SELECT *, round_even({aqi_sql('pm25_daily')}, 0) AS aqi FROM daily) a) b
GROUP BY 1, 2
""")
def aqi_by_country(spark, sf_dir):
    """Flagship: raw events to station-days per country and index category."""
    days = domain.daily(spark, sf_dir).withColumn(
        "aqi", aqi.round_aqi(aqi.pm25_to_aqi(F.col("pm25_daily"))))
    return days.groupBy("country", aqi.aqi_category(F.col("aqi")).alias("category")).agg(
        F.count(F.lit(1)).alias("station_days"), r6(F.avg("aqi")).alias("mean_aqi"),
        r6(F.max("pm25_daily")).alias("max_pm25"))


@query("unit_conversion", parts=["obs_u"], sql="""
SELECT coalesce(units, '(none)') AS units, count(*) AS rows, count(pm25_ug_m3) AS converted,
  ROUND(avg(pm25_ug_m3), 6) AS mean_ug_m3, ROUND(max(pm25_ug_m3), 6) AS max_ug_m3
FROM obs_u GROUP BY 1
""")
def unit_conversion(spark, sf_dir):
    return domain.converted(spark, sf_dir).groupBy(
        F.coalesce("units", F.lit("(none)")).alias("units")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("pm25_ug_m3").alias("converted"),
        r6(F.avg("pm25_ug_m3")).alias("mean_ug_m3"), r6(F.max("pm25_ug_m3")).alias("max_ug_m3"))


@query("normalized_units", parts=["obs"], sql="""
SELECT unit, count(*) AS rows FROM (
  SELECT CASE WHEN units IS NULL THEN '' WHEN units IN ('ug/m3', 'μg/m³', ' UG/m^3 ') THEN 'ug/m3'
    ELSE units END AS unit FROM obs) u GROUP BY 1
""")
def normalized_units(spark, sf_dir):
    return domain.observations(spark, sf_dir).groupBy(
        units.normalize_unit(F.col("units")).alias("unit")).agg(F.count(F.lit(1)).alias("rows"))


@query("text_coercion", sql="""
SELECT count(*) AS rows, count(v) AS numbers, count(t) AS instants,
  strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first_instant,
  strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last_instant
FROM (SELECT CASE WHEN event_id % 5 <> 0 THEN value END AS v,
  CASE WHEN event_id % 7 = 0 THEN NULL
       WHEN event_id % 3 = 0 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE
       ELSE date_trunc('second', ts) - INTERVAL 330 MINUTE END AS t FROM events) x
""")
def text_coercion(spark, sf_dir):
    """Values and local times as text, some unreadable, some with an offset."""
    ev = domain.table(spark, sf_dir, "events")
    plain = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    text = (F.when(F.col("event_id") % 7 == 0, "not-a-date")
            .when(F.col("event_id") % 3 == 0, F.concat(plain, F.lit("+05:30"))).otherwise(plain))
    value = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))
    typed = ev.select(value.alias("v"), text.alias("t")).select(
        F.col("v").try_cast("double").alias("v"), coerce_timestamp(F.col("t"), "Asia/Kolkata").alias("t"))
    return typed.agg(F.count(F.lit(1)).alias("rows"), F.count("v").alias("numbers"),
                     F.count("t").alias("instants"), stamp(F.min("t"), "first_instant"),
                     stamp(F.max("t"), "last_instant"))


@query("observation_qc", parts=["obs_checked"], sql="""
SELECT CAST(sum(n_rows) AS BIGINT) AS input_rows, CAST(sum(n_rows - 1) AS BIGINT) AS duplicate_rows,
  count(*) FILTER (reject_reason = 'invalid_coordinates') AS invalid_coordinates,
  count(*) FILTER (reject_reason = 'invalid_timestamps') AS invalid_timestamps,
  count(*) FILTER (reject_reason = 'invalid_units') AS invalid_units,
  count(*) FILTER (reject_reason = 'missing_pm25') AS missing_pm25,
  count(*) FILTER (reject_reason = 'negative_pm25') AS negative_pm25,
  count(*) FILTER (reject_reason = 'above_max_pm25') AS above_max_pm25,
  count(*) FILTER (reject_reason IS NULL) AS retained_rows
FROM obs_checked
""")
def observation_qc(spark, sf_dir):
    return qc.attrition(domain.checked(spark, sf_dir), qc.OBSERVATION_RULES)


@query("station_qc", parts=["obs"], sql="""
SELECT CAST(sum(n) AS BIGINT) AS input_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
  count(*) FILTER (r = 'missing_timestamps') AS missing_timestamps,
  count(*) FILTER (r = 'missing_station_ids') AS missing_station_ids,
  count(*) FILTER (r = 'missing_coordinates') AS missing_coordinates,
  count(*) FILTER (r = 'invalid_coordinates') AS invalid_coordinates,
  count(*) FILTER (r = 'impossible_coordinates') AS impossible_coordinates,
  count(*) FILTER (r = 'missing_pm25') AS missing_pm25,
  count(*) FILTER (r = 'non_finite_values') AS non_finite_values,
  count(*) FILTER (r = 'negative_pm25') AS negative_pm25,
  count(*) FILTER (r = 'invalid_pm25') AS invalid_pm25,
  count(*) FILTER (r IS NULL) AS retained_rows
FROM (SELECT n, CASE WHEN timestamp IS NULL THEN 'missing_timestamps'
    WHEN latitude NOT BETWEEN -90 AND 90 THEN 'invalid_coordinates'
    WHEN longitude > 77.4::DOUBLE OR latitude > 28.75::DOUBLE THEN 'impossible_coordinates'
    WHEN pm IS NULL THEN 'missing_pm25' WHEN pm < 0 THEN 'negative_pm25'
    WHEN pm > 1000 THEN 'invalid_pm25' END AS r
  FROM (SELECT *, count(*) OVER k AS n, row_number() OVER (k ORDER BY ordinal) AS rn
        FROM obs WINDOW k AS (PARTITION BY station_id, timestamp)) a WHERE rn = 1) b
""")
def station_qc(spark, sf_dir):
    checked = qc.station_qc(domain.observations(spark, sf_dir), "ordinal",
                            valid_bounds=(77.0, 28.4, 77.4, 28.75))
    return qc.attrition(checked, qc.STATION_RULES)


@query("clean_observations", parts=["clean"], sql="""
SELECT ordinal, station_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp,
  ROUND(latitude, 6) AS latitude, ROUND(longitude, 6) AS longitude,
  ROUND(pm25_ug_m3, 6) AS pm25_ug_m3 FROM clean
""")
def clean_observations(spark, sf_dir):
    return domain.clean(spark, sf_dir).select(
        "ordinal", "station_id", stamp("timestamp", "timestamp"), r6("latitude").alias("latitude"),
        r6("longitude").alias("longitude"), r6("pm25_ug_m3").alias("pm25_ug_m3"))


@query("outlier_flags", parts=["clean"], sql="""
WITH m AS (SELECT quantile_cont(pm25_ug_m3, 0.5) AS med FROM clean),
d AS (SELECT quantile_cont(abs(pm25_ug_m3 - med), 0.5) * 1.4826::DOUBLE AS mad FROM clean, m)
SELECT source, count(*) AS rows,
  count(*) FILTER (mad > 0 AND abs(pm25_ug_m3 - med) > mad * 5.0::DOUBLE) AS outliers,
  ROUND(max(med), 6) AS median, ROUND(max(mad), 6) AS mad
FROM clean, m, d GROUP BY 1
""")
def outlier_flags(spark, sf_dir):
    clean = materialize(domain.clean(spark, sf_dir).select("source", "pm25_ug_m3"), "clean")
    centre, mad = qc.median_and_mad(clean, "pm25_ug_m3")
    flagged = qc.mad_outlier_flag(clean, "pm25_ug_m3", 5.0, stats=(centre, mad))
    return flagged.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("outlier_flag"), 1)).alias("outliers"),
        r6(F.lit(centre)).alias("median"), r6(F.lit(mad)).alias("mad"))


@query("iqr_outlier_ratio", parts=["daily"], sql="""
WITH q AS (SELECT quantile_cont(pm25_daily, 0.25) AS q1, quantile_cont(pm25_daily, 0.75) AS q3 FROM daily)
SELECT count(*) AS n,
  count(*) FILTER (q3 > q1 AND (pm25_daily < q1 - (q3 - q1) * 3.0::DOUBLE
    OR pm25_daily > q3 + (q3 - q1) * 3.0::DOUBLE)) AS n_outliers,
  ROUND(avg(CASE WHEN q3 > q1 AND (pm25_daily < q1 - (q3 - q1) * 3.0::DOUBLE
    OR pm25_daily > q3 + (q3 - q1) * 3.0::DOUBLE) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS outlier_ratio
FROM daily, q
""")
def iqr_outlier_ratio(spark, sf_dir):
    return rounded(qc.iqr_outlier_ratio(domain.daily(spark, sf_dir), "pm25_daily"), "outlier_ratio")


@query("observation_report", parts=["clean"], sql="""
SELECT count(*) AS observations, count(DISTINCT station_id) AS station_count,
  count(DISTINCT country) AS country_count, strftime(min(timestamp), '%Y-%m-%d') AS first_date,
  strftime(max(timestamp), '%Y-%m-%d') AS last_date, ROUND(min(pm25_ug_m3), 6) AS min_value,
  ROUND(max(pm25_ug_m3), 6) AS max_value, ROUND(avg(pm25_ug_m3), 6) AS mean_value FROM clean
""")
def observation_report(spark, sf_dir):
    row = qc.observation_summary(domain.clean(spark, sf_dir))
    return rounded(row, "min_value", "max_value", "mean_value").withColumns({
        c: F.date_format(c, "yyyy-MM-dd") for c in ("first_date", "last_date")})


@query("station_daily_means", parts=["daily"], sql="""
SELECT station_id, strftime(date, '%Y-%m-%d') AS date, ROUND(pm25_daily, 6) AS pm25_daily,
  observation_count, ROUND(latitude, 6) AS latitude, ROUND(longitude, 6) AS longitude, country, source
FROM daily WHERE observation_count >= 2
""")
def station_daily_means(spark, sf_dir):
    out = domain.daily(spark, sf_dir, min_observations=2)
    return rounded(out, "pm25_daily", "latitude", "longitude").withColumn(
        "date", F.date_format("date", "yyyy-MM-dd"))


@query("daily_report", parts=["daily"], sql="""
SELECT count(*) FILTER (observation_count < 2) AS station_days_skipped,
  count(*) FILTER (observation_count >= 2) AS station_days_retained,
  count(DISTINCT station_id) FILTER (observation_count >= 2) AS stations,
  count(DISTINCT country) FILTER (observation_count >= 2) AS countries FROM daily
""")
def daily_report(spark, sf_dir):
    return D.daily_report(domain.clean(spark, sf_dir), min_observations=2)


@query("local_daily_means", parts=["clean"], sql="""
SELECT station_id, strftime(CAST(timestamp + INTERVAL 330 MINUTE AS DATE), '%Y-%m-%d') AS date,
  ROUND(avg(pm25_ug_m3), 6) AS pm25, count(*) AS observation_count,
  ROUND(arg_max(latitude, timestamp), 6) AS latitude
FROM clean GROUP BY 1, 2
""")
def local_daily_means(spark, sf_dir):
    obs = domain.clean(spark, sf_dir).drop("PM2.5").withColumnRenamed("pm25_ug_m3", "PM2.5")
    out = D.daily_mean_local(obs)
    return out.select("station_id", day("date"), r6("`PM2.5`").alias("pm25"), "observation_count",
                      r6("latitude").alias("latitude"))


@query("station_summary", parts=["obs"], sql="""
SELECT station_id, ROUND(arg_max(longitude, timestamp), 6) AS longitude,
  count(timestamp) AS observation_count,
  strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS first_timestamp,
  strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last_timestamp,
  count(*) FILTER (pm IS NULL) AS missing_pm25_count
FROM obs GROUP BY 1
""")
def station_summary(spark, sf_dir):
    out = D.station_summary(domain.observations(spark, sf_dir))
    return out.select("station_id", r6("longitude").alias("longitude"), "observation_count",
                      stamp("first_timestamp", "first_timestamp"), stamp("last_timestamp", "last_timestamp"),
                      F.col("missing_PM25_count").alias("missing_pm25_count"))


@query("station_registry", parts=["daily"], sql="""
SELECT station_id, source, country, ROUND(arg_min(latitude, date), 6) AS latitude,
  ROUND(arg_min(longitude, date), 6) AS longitude, strftime(min(date), '%Y-%m-%d') AS first_timestamp,
  strftime(max(date), '%Y-%m-%d') AS last_timestamp, CAST(sum(observation_count) AS BIGINT) AS n_observations,
  count(*) AS n_days
FROM daily GROUP BY 1, 2, 3
""")
def station_registry(spark, sf_dir):
    return rounded(D.export_registry(D.station_registry(domain.daily(spark, sf_dir))),
                   "latitude", "longitude")


@query("country_summary", parts=["daily"], sql="""
SELECT country, count(DISTINCT station_id) AS n_stations,
  CAST(sum(observation_count) AS BIGINT) AS n_observations FROM daily GROUP BY 1
""")
def country_summary(spark, sf_dir):
    return D.country_summary(D.station_registry(domain.daily(spark, sf_dir)))


@query("latest_per_station", parts=["daily"], sql="""
SELECT station_id, strftime(max(date), '%Y-%m-%d') AS date,
  ROUND(arg_max(pm25_daily, date), 6) AS latest_pm25 FROM daily GROUP BY 1
""")
def latest_per_station(spark, sf_dir):
    out = latest(domain.daily(spark, sf_dir), ["station_id"], "date", ["date", "pm25_daily"])
    return out.select("station_id", day("date"), r6("pm25_daily").alias("latest_pm25"))


@query("ground_truth_union", parts=["obs"], sql="""
WITH tagged AS (
  SELECT *, CASE WHEN source IN ('click', 'view') THEN 'cpcb' ELSE 'openaq' END AS net FROM obs),
kept AS (SELECT * FROM tagged WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180
  AND pm IS NOT NULL AND timestamp IS NOT NULL),
first AS (SELECT *, row_number() OVER (PARTITION BY station_id, net, timestamp ORDER BY ordinal) AS rn FROM kept)
SELECT station_id, net AS source, CASE WHEN net = 'cpcb' THEN 'India' ELSE country END AS country,
  strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, ROUND(pm, 6) AS pm25, 'ug/m3' AS units,
  net || '_reported' AS quality_flag
FROM first WHERE rn = 1
""")
def ground_truth_union(spark, sf_dir):
    obs = domain.observations(spark, sf_dir)
    first = F.col("source").isin("click", "view")
    out = union_ground_truth(
        {"cpcb": obs.where(first), "openaq": obs.where(~first)},
        {"cpcb": {"country": "India", "units": "ug/m3", "quality_flag": "cpcb_reported"},
         "openaq": {"units": "ug/m3", "quality_flag": "openaq_reported"}}, "ordinal")
    return out.select("station_id", "source", "country", stamp("timestamp", "timestamp"),
                      r6("`PM2.5`").alias("pm25"), "units", "quality_flag")


@query("aqi_schemes", parts=["daily"], sql=f"""
SELECT station_id, strftime(date, '%Y-%m-%d') AS date, ROUND({aqi_sql('pm25_daily')}, 6) AS cpcb_aqi,
  {category_sql('round_even(' + aqi_sql('pm25_daily') + ', 0)')} AS cpcb_category,
  ROUND({epa_sql('pm25_daily')}, 6) AS epa_aqi,
  {epa_category_sql('round_even(' + epa_sql('pm25_daily') + ', 0)')} AS epa_category,
  CAST(floor({aqi_sql('pm25_daily')}) AS BIGINT) AS cpcb_floor
FROM daily
""")
def aqi_schemes(spark, sf_dir):
    c = F.col("pm25_daily")
    cpcb, epa = aqi.pm25_to_aqi(c), aqi.pm25_to_aqi(c, "us_epa")
    return domain.daily(spark, sf_dir).select(
        "station_id", day("date"), r6(cpcb).alias("cpcb_aqi"),
        aqi.aqi_category(aqi.round_aqi(cpcb)).alias("cpcb_category"), r6(epa).alias("epa_aqi"),
        aqi.aqi_category(aqi.round_aqi(epa), "us_epa").alias("epa_category"),
        aqi.round_aqi(cpcb, "floor").alias("cpcb_floor"))


@query("aqi_scheme_by_region", parts=["daily"], sql=f"""
WITH tagged AS (
  SELECT *, CASE WHEN r_name LIKE 'A%' THEN 'global' WHEN r_name LIKE 'E%' THEN 'delhi' ELSE lower(r_name) END AS reg
  FROM daily JOIN nation ON n_name = country JOIN region ON n_regionkey = r_regionkey)
SELECT reg AS region, CASE WHEN reg = 'global' THEN 'none' ELSE 'india_cpcb' END AS scheme,
  count(*) AS rows, count(CASE WHEN reg <> 'global' THEN pm25_daily END) AS with_index,
  ROUND(avg(CASE WHEN reg <> 'global' THEN {aqi_sql('pm25_daily')} END), 6) AS mean_aqi
FROM tagged GROUP BY 1, 2
""")
def aqi_scheme_by_region(spark, sf_dir):
    """Index under the scheme of the region; one region refuses an index."""
    nation, region = (domain.table(spark, sf_dir, t) for t in ("nation", "region"))
    lookup = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("country"), "r_name")
    reg = (F.when(F.col("r_name").startswith("A"), "global")
           .when(F.col("r_name").startswith("E"), "delhi").otherwise(F.lower("r_name")))
    rows = domain.daily(spark, sf_dir).join(lookup, "country").withColumn("region", reg).withColumn(
        "scheme", aqi.aqi_scheme_for(F.col("region")))
    value = aqi.aqi_by_scheme(F.col("pm25_daily"), F.col("scheme"))
    return rows.withColumn("aqi", value).groupBy("region", "scheme").agg(
        F.count(F.lit(1)).alias("rows"), F.count("aqi").alias("with_index"),
        r6(F.avg("aqi")).alias("mean_aqi"))


@query("scope_of_stations", parts=["stations"], sql="""
SELECT CASE WHEN longitude >= 77.0::DOUBLE - 1e-9 AND latitude >= 28.4::DOUBLE - 1e-9
     AND longitude <= 77.4::DOUBLE + 1e-9 AND latitude <= 28.8::DOUBLE + 1e-9 THEN 'delhi'
   ELSE 'india' END AS scope, count(*) AS stations,
  count(*) FILTER (longitude <= 77.4::DOUBLE + 1e-9 AND latitude <= 28.8::DOUBLE + 1e-9) AS isolated_for_delhi
FROM stations GROUP BY 1
""")
def scope_of_stations(spark, sf_dir):
    lon, lat = F.col("longitude"), F.col("latitude")
    rows = domain.stations(spark, sf_dir).withColumn("scope", geo.infer_scope(lon, lat, lon, lat))
    return rows.groupBy("scope").agg(
        F.count(F.lit(1)).alias("stations"),
        F.count(F.when(geo.scope_isolated(F.lit("delhi"), F.col("scope")), 1)).alias("isolated_for_delhi"))


@query("aoi_availability", parts=["clean"], sql="""
WITH a(aoi, w, s, e, n) AS (VALUES ('delhi', 77.0::DOUBLE, 28.4::DOUBLE, 77.4::DOUBLE, 28.8::DOUBLE),
  ('pune', 73.7, 18.4, 74.1, 18.7), ('mumbai', 72.7, 18.8, 73.0, 19.3),
  ('india', 65.0, 5.0, 100.0, 40.0), ('global', -180.0, -90.0, 180.0, 90.0))
SELECT aoi, source, count(*) AS n_rows, count(DISTINCT station_id) AS n_stations,
  CASE WHEN aoi = 'global' THEN 'data_limited' ELSE 'available' END AS overall
FROM clean JOIN a ON longitude BETWEEN w AND e AND latitude BETWEEN s AND n GROUP BY 1, 2
""")
def aoi_availability(spark, sf_dir):
    return S.aoi_availability(domain.clean(spark, sf_dir), S.REGIONS, by="source")


@query("countries_and_regions", parts=["daily"], sql="""
SELECT country, 'Unclassified' AS region, r_name AS region_in_table,
  count(DISTINCT station_id) AS n_stations
FROM daily JOIN nation ON n_name = country JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3
""")
def countries_and_regions(spark, sf_dir):
    nation, region = (domain.table(spark, sf_dir, t) for t in ("nation", "region"))
    lookup = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("country"), F.col("r_name").alias("region_in_table"))
    return domain.daily(spark, sf_dir).join(lookup, "country").groupBy(
        "country", geo.region_of_country(F.col("country")).alias("region"), "region_in_table").agg(
        F.countDistinct("station_id").alias("n_stations"))
