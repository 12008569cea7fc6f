"""Queries on the training table: coverage, quality, leakage, readiness, groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from airq.operators import features as FT, folds as FO, leakage as L, nearest as N, readiness as RE
from airq.operators import reports as RP, uncertainty as U
from airq.operators.grid import assign_cell, assign_parent, make_grid
from airq.plans.registry import day, query, r6, rounded
from airq.plans.sql_parts import part
from airq.schemas import FEATURES, GRIDDED_FEATURES, TARGET
from airq.session import materialize
from airq.sources import domain

_NUM = [TARGET, *FEATURES]


def _q(name: str) -> str:
    return f'"{name}"'


def _each(template: str, columns: list[str]) -> str:
    """One SELECT per column, joined by UNION ALL."""
    return "\nUNION ALL\n".join(template.format(c=_q(c), n=c) for c in columns)


@query("training_table", parts=["training"], sql=f"""
SELECT station_id, country, strftime(date, '%Y-%m-%d') AS date, complete_case, CAST(n_features_available AS BIGINT) AS n_features_available,
  {', '.join(f'ROUND({_q(c)}, 6) AS {_q(c.replace(".", ""))}' for c in _NUM if c != "wind_direction_deg")},
  ROUND(wind_direction_deg, 4) AS wind_direction_deg FROM training
""")
def training_table(spark, sf_dir):
    t = domain.training(spark, sf_dir)
    return t.select("station_id", "country", day("date"), "complete_case",
                    F.col("n_features_available").cast("bigint").alias("n_features_available"),
                    *[r6(f"`{c}`").alias(c.replace(".", "")) for c in _NUM if c != "wind_direction_deg"],
                    F.round("wind_direction_deg", 4).alias("wind_direction_deg"))


@query("observations_with_features", parts=["daily", "features_1km"], sql="""
WITH o AS (SELECT *, CAST(floor((latitude - 28.4::DOUBLE) / 0.05::DOUBLE) AS BIGINT) AS r,
  CAST(floor((longitude - 77.0::DOUBLE) / 0.05::DOUBLE) AS BIGINT) AS c FROM daily WHERE latitude < 28.85 AND longitude < 77.45)
SELECT o.country, count(*) FILTER (f.date IS NOT NULL) AS matched_rows,
  (SELECT count(*) FROM o o2 WHERE NOT EXISTS (SELECT 1 FROM features_1km f WHERE f.cell_row = o2.r AND f.cell_col = o2.c AND f.date = o2.date)) AS unmatched_rows,
  ROUND(avg(f.temperature_c), 6) AS mean_temperature
FROM o JOIN features_1km f ON f.cell_row = o.r AND f.cell_col = o.c AND f.date = o.date GROUP BY 1
""")
def observations_with_features(spark, sf_dir):
    obs = assign_cell(domain.daily(spark, sf_dir), domain.STATION_GRID, "longitude", "latitude").where(
        F.col("cell_row").isNotNull())
    matched, unmatched = FT.join_obs_features(
        obs, domain.features_1km(spark, sf_dir), ["cell_row", "cell_col", "date"])
    return matched.groupBy("country").agg(
        F.count(F.lit(1)).alias("matched_rows"), r6(F.avg("temperature_c")).alias("mean_temperature")
    ).withColumn("unmatched_rows", unmatched.scalar())


@query("attached_features", parts=["daily", "cell_static"], sql="""
SELECT station_id, strftime(date, '%Y-%m-%d') AS date, ROUND(elevation_m, 6) AS elevation_m,
  elevation_m IS NOT NULL AS elevation_m_available, ROUND(road_density, 6) AS road_density,
  road_density IS NOT NULL AS road_density_available, FALSE AS snow_available
FROM daily LEFT JOIN (SELECT * FROM cell_static WHERE (cell_row + cell_col) % 4 <> 0)
  ON cell_row = CAST(floor((latitude - 28.4::DOUBLE) / 0.05::DOUBLE) AS BIGINT)
  AND cell_col = CAST(floor((longitude - 77.0::DOUBLE) / 0.05::DOUBLE) AS BIGINT)
""")
def attached_features(spark, sf_dir):
    """Layers with holes and one layer that was never acquired."""
    obs = assign_cell(domain.daily(spark, sf_dir), domain.STATION_GRID, "longitude", "latitude")
    layer = domain.cell_static(spark, sf_dir).where((F.col("cell_row") + F.col("cell_col")) % 4 != 0)
    out = FT.attach_features(obs, {"elevation_m": layer, "road_density": layer, "snow": None},
                             ["cell_row", "cell_col"])
    return out.select("station_id", day("date"), r6("elevation_m").alias("elevation_m"),
                      "elevation_m_available", r6("road_density").alias("road_density"),
                      "road_density_available", "snow_available")


@query("station_geo_index", parts=["clean"], sql="""
SELECT station_id, ROUND(arg_min(latitude, ordinal), 6) AS latitude, arg_min(country, ordinal) AS country,
  arg_min(country, ordinal) AS region, station_id AS city FROM clean GROUP BY 1
""")
def station_geo_index(spark, sf_dir):
    return FT.station_geo_index(domain.clean(spark, sf_dir), "ordinal").select(
        "station_id", r6("latitude").alias("latitude"), "country", "region", "city")


@query("missingness", parts=["training"], sql=_each(
    "SELECT '{n}' AS \"column\", count({c}) AS n_non_null, count(*) - count({c}) AS n_null, "
    "ROUND((count(*) - count({c})) / count(*)::DOUBLE, 6) AS pct_missing FROM training", _NUM))
def missingness(spark, sf_dir):
    return rounded(RP.missingness(domain.training(spark, sf_dir), _NUM), "pct_missing")


_DISTINCT_SAFE = ["AOD", "elevation_m", "road_density", "month", "day_of_year"]


@query("feature_coverage", parts=["training"], sql=_each(
    "SELECT '{n}' AS feature, count({c}) AS valid_count, count(*) - count({c}) AS missing_count, "
    "ROUND(100.0::DOUBLE * (count(*) - count({c})) / count(*), 6) AS missing_percentage FROM training", FEATURES))
def feature_coverage(spark, sf_dir):
    out = RP.feature_coverage(domain.training(spark, sf_dir), FEATURES)
    return rounded(out.drop("unique_count"), "missing_percentage")


@query("distinct_values", sql="""
SELECT 'l_quantity' AS feature, count(*) AS valid_count, count(DISTINCT l_quantity) AS unique_count FROM lineitem
UNION ALL SELECT 'l_discount', count(*), count(DISTINCT l_discount) FROM lineitem
UNION ALL SELECT 'l_tax', count(*), count(DISTINCT l_tax) FROM lineitem
""")
def distinct_values(spark, sf_dir):
    out = RP.feature_coverage(domain.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return out.select("feature", "valid_count", "unique_count")


@query("top_missing_features", parts=["training"], sql="""
SELECT feature, ROUND(p, 6) AS missing_percentage FROM (""" + _each(
    "SELECT '{n}' AS feature, 100.0::DOUBLE * (count(*) - count({c})) / count(*) AS p FROM training", FEATURES) + """) x
ORDER BY p DESC, feature LIMIT 3
""")
def top_missing_features(spark, sf_dir):
    return rounded(RP.top_missing(RP.feature_coverage(domain.training(spark, sf_dir), FEATURES)),
                   "missing_percentage")


@query("coverage_by_country", parts=["training"], sql="""
SELECT coalesce(country, '(unknown)') AS country, count(station_id) AS n_rows, count(DISTINCT station_id) AS n_stations,
  count(*) FILTER (complete_case) AS n_complete_rows, ROUND(avg(CAST(complete_case AS INT)), 6) AS pct_complete FROM training GROUP BY 1
""")
def coverage_by_country(spark, sf_dir):
    return rounded(RP.coverage_by_country(domain.training(spark, sf_dir)), "pct_complete")


@query("top_countries", parts=["training"], sql="""
SELECT country, count(*) AS n_rows FROM training GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15
""")
def top_countries(spark, sf_dir):
    return RP.top_countries(RP.coverage_by_country(domain.training(spark, sf_dir))).select("country", "n_rows")


@query("coverage_by_month", parts=["training"], sql="""
SELECT strftime(date, '%Y-%m') AS month, count(station_id) AS n_rows, count(DISTINCT station_id) AS n_stations,
  count(*) FILTER (complete_case) AS n_complete_rows FROM training GROUP BY 1
""")
def coverage_by_month(spark, sf_dir):
    return RP.coverage_by_month(domain.training(spark, sf_dir))


@query("geographic_bias", parts=["training"], sql="SELECT * FROM (" + _each(
    "SELECT '{n}' AS feature, ROUND(min(r), 6) AS min_pct_missing, ROUND(max(r), 6) AS max_pct_missing FROM "
    "(SELECT avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS r FROM training GROUP BY country) x", FEATURES)
    + ") y WHERE max_pct_missing > min_pct_missing")
def geographic_bias(spark, sf_dir):
    return rounded(RP.geographic_bias(domain.training(spark, sf_dir)), "min_pct_missing", "max_pct_missing")


@query("target_qc", parts=["obs"], sql="""
WITH t AS (SELECT station_id, CAST(timestamp AS DATE) AS date, pm FROM obs)
SELECT count(*) AS total_candidate_rows, count(*) FILTER (pm IS NULL) AS missing_target, count(*) FILTER (pm < 0) AS negative_target,
  count(*) FILTER (pm = 0) AS zero_target, count(*) FILTER (pm IS NULL OR pm < 0) AS invalid_target_rows,
  (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM t GROUP BY station_id, date) x) AS duplicate_station_date FROM t
""")
def target_qc(spark, sf_dir):
    rows = domain.observations(spark, sf_dir).withColumn("date", F.to_date("timestamp"))
    return RP.target_qc(rows)


@query("table_qc", parts=["training"], sql="""
SELECT count(*) AS rows, count(*) FILTER (date IS NULL) AS invalid_dates, count(*) FILTER ("PM2.5" < 0) AS negative_target,
  count(*) FILTER ("PM2.5" > 300) AS above_max_target,
  (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM training GROUP BY station_id, date) x) AS duplicate_station_dates FROM training
""")
def table_qc(spark, sf_dir):
    return RP.table_qc(domain.training(spark, sf_dir), max_value=300.0)


@query("target_report", parts=["training"], sql="""
SELECT count(*) AS rows, count("PM2.5") AS n_target_valid, count(*) FILTER (complete_case) AS n_complete_case_rows,
  ROUND(avg(CAST(complete_case AS INT)), 6) AS complete_case_ratio, ROUND(avg("PM2.5"), 6) AS mean, ROUND(min("PM2.5"), 6) AS min,
  ROUND(max("PM2.5"), 6) AS max, ROUND(stddev_samp("PM2.5"), 6) AS std, strftime(min(date), '%Y-%m-%d') AS first_date,
  strftime(max(date), '%Y-%m-%d') AS last_date, count(DISTINCT date) AS n_days, ROUND(quantile_cont("PM2.5", 0.25), 6) AS p25,
  ROUND(quantile_cont("PM2.5", 0.5), 6) AS median, ROUND(quantile_cont("PM2.5", 0.75), 6) AS p75,
  CASE WHEN count(*) FILTER (complete_case) >= 20 THEN 'sufficient' ELSE 'insufficient' END AS completeness_flag FROM training
""")
def target_report(spark, sf_dir):
    out = RP.target_report(domain.written_training(spark, sf_dir))
    return rounded(out, "complete_case_ratio", "mean", "min", "max", "std", "p25", "median", "p75").withColumns(
        {c: F.date_format(c, "yyyy-MM-dd") for c in ("first_date", "last_date")})


@query("station_medians", parts=["clean"], sql="""
SELECT station_id, ROUND(quantile_cont(pm25_ug_m3, 0.1), 6) AS p10, ROUND(quantile_cont(pm25_ug_m3, 0.5), 6) AS median,
  ROUND(quantile_cont(pm25_ug_m3, 0.9), 6) AS p90 FROM clean GROUP BY 1
""")
def station_medians(spark, sf_dir):
    """Exact quantiles per group without gathering a group."""
    from airq.operators.ranks import exact_quantiles
    out = exact_quantiles(domain.clean(spark, sf_dir), "pm25_ug_m3",
                          {"p10": 0.1, "median": 0.5, "p90": 0.9}, by=["station_id"])
    return rounded(out, "p10", "median", "p90")


@query("target_by_country", parts=["training"], sql="""
SELECT coalesce(country, '(unknown)') AS country, count("PM2.5") AS count, ROUND(avg("PM2.5"), 6) AS mean FROM training GROUP BY 1
""")
def target_by_country(spark, sf_dir):
    return rounded(RP.target_by(domain.training(spark, sf_dir), "country"), "mean")


@query("target_by_station", parts=["training"], sql="""
SELECT station_id, count("PM2.5") AS count, ROUND(avg("PM2.5"), 8) AS mean FROM training GROUP BY 1
""")
def target_by_station(spark, sf_dir):
    return rounded(RP.target_by(domain.training(spark, sf_dir), "station_id"), "mean", digits=8)


@query("representativeness", parts=["training"], sql="""
SELECT count(DISTINCT station_id) AS stations, count(DISTINCT country) AS countries, count(DISTINCT date) AS n_days,
  strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date,
  ROUND(count(DISTINCT station_id) / 510.1::DOUBLE, 6) AS spatial_density FROM training
""")
def representativeness(spark, sf_dir):
    out = RP.representativeness(domain.training(spark, sf_dir))
    return rounded(out, "spatial_density").withColumns(
        {c: F.date_format(c, "yyyy-MM-dd") for c in ("first_date", "last_date")})


_CORR = ["AOD", "temperature_c", "relative_humidity_pct", "wind_speed_mps", "NDVI", "night_lights"]
_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1:]]


@query("pearson_matrix", parts=["training"], sql="\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, ROUND(corr({_q(a)}, {_q(b)}), 6) AS pearson, "
    f"count(*) FILTER ({_q(a)} IS NOT NULL AND {_q(b)} IS NOT NULL) AS n FROM training" for a, b in _PAIRS))
def pearson_matrix(spark, sf_dir):
    return rounded(RP.pearson_matrix(domain.training(spark, sf_dir), _CORR), "pearson")


_RANKED = "SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {_q(c)}) + (count(*) OVER (PARTITION BY {_q(c)}) - 1) / 2.0::DOUBLE AS r{i}, {_q(c)} AS x{i}"
    for i, c in enumerate([TARGET, *_CORR])) + " FROM training WHERE " + " AND ".join(
    f"{_q(c)} IS NOT NULL" for c in [TARGET, *_CORR])
_ALL = [TARGET, *_CORR]


@query("correlation_pairs", parts=["training"], sql=f"WITH k AS ({_RANKED})\n" + "\nUNION ALL\n".join(
    f"SELECT '{_ALL[i]}' AS feature_a, '{_ALL[j]}' AS feature_b, ROUND(corr(x{i}, x{j}), 4) AS pearson, "
    f"ROUND(corr(r{i}, r{j}), 4) AS spearman, count(*) AS n FROM k"
    for i in range(len(_ALL)) for j in range(i + 1, len(_ALL))))
def correlation_pairs(spark, sf_dir):
    rows = domain.written_training(spark, sf_dir)
    out = RP.correlation_pairs(rows, _ALL, ["station_id", "date"])
    return rounded(out, "pearson", "spearman", digits=4)


part("labelled", """
SELECT station_id, coalesce(country, '(unknown)') AS country,
  CASE country WHEN 'NATION_1' THEN 'Unclassified' ELSE 'Unclassified' END AS region FROM training
""", "training")


@query("group_statistics", parts=["labelled"], sql="""
SELECT 'all' AS level, 'all' AS name, count(DISTINCT station_id) AS stations, count(DISTINCT country) AS countries, count(DISTINCT region) AS regions FROM labelled
UNION ALL SELECT 'region', region, count(DISTINCT station_id), count(DISTINCT country), 1 FROM labelled GROUP BY region
UNION ALL SELECT 'country', country, count(DISTINCT station_id), 1, count(DISTINCT region) FROM labelled GROUP BY country
""")
def group_statistics(spark, sf_dir):
    return RP.group_statistics(RP.spatial_group_labels(domain.training(spark, sf_dir)))


@query("spatial_group_labels", parts=["training"], sql="""
SELECT 'station_' || station_id AS fold_station, 'country_' || coalesce(country, '(unknown)') AS fold_country,
  'Unclassified' AS region, count(*) AS rows FROM training GROUP BY 1, 2, 3
""")
def spatial_group_labels(spark, sf_dir):
    return RP.spatial_group_labels(domain.training(spark, sf_dir)).groupBy(
        "fold_station", "fold_country", "region").agg(F.count(F.lit(1)).alias("rows"))


@query("loso_loco_status", parts=["training"], sql="""
WITH s AS (SELECT count(DISTINCT station_id) AS s, count(DISTINCT country) AS c, count(*) FILTER (complete_case) AS k FROM training)
SELECT 'Leave-One-Station-Out' AS method, s AS n_groups, 5::BIGINT AS min_groups, k AS n_complete_case_rows,
  CASE WHEN s >= 5 AND k >= 2 * s THEN 'READY' ELSE 'INSUFFICIENT_DATA' END AS status FROM s
UNION ALL SELECT 'Leave-One-Country-Out', c, 2, k, CASE WHEN c >= 2 AND k >= 2 * c THEN 'READY' ELSE 'INSUFFICIENT_DATA' END FROM s
""")
def loso_loco_status(spark, sf_dir):
    return RP.loso_loco_status(domain.training(spark, sf_dir))


@query("alignment_coverage", parts=["features_1km"], sql=_each(
    "SELECT '{n}' AS source, count({c}) AS present, count(*) AS total, ROUND(100.0::DOUBLE * count({c}) / count(*), 6) AS percent_available FROM features_1km",
    ["AOD", "temperature_c", "NDVI", "elevation_m", "road_density", "night_lights"]))
def alignment_coverage(spark, sf_dir):
    names = ["AOD", "temperature_c", "NDVI", "elevation_m", "road_density", "night_lights"]
    return rounded(RP.alignment_coverage(domain.features_1km(spark, sf_dir), {n: n for n in names}),
                   "percent_available")


@query("alignment_checks", parts=["daily", "cell_days", "pixels"], sql="""
WITH f AS (SELECT *, dayofmonth(date) AS d FROM cell_days UNION ALL SELECT *, dayofmonth(date) FROM cell_days WHERE dayofmonth(date) = 9),
c AS (
  SELECT 'no_duplicate_grid_date' AS "check", CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS violations FROM (SELECT count(*) AS n FROM f GROUP BY cell_row, cell_col, date) x
  UNION ALL SELECT 'no_duplicate_station_date', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM daily GROUP BY station_id, date) x
  UNION ALL SELECT 'parent_ids_unique', count(*) FILTER ((r + c) % 41 = 0 AND (r + c) % 37 <> 0) FROM (SELECT DISTINCT row // 2 AS r, col // 2 AS c FROM pixels) x
  UNION ALL SELECT 'child_ids_unique', count(*) FILTER ((row + col) % 43 = 0) FROM pixels
  UNION ALL SELECT 'target_not_in_features', count(*) FROM (DESCRIBE cell_days) x WHERE column_name = 'PM2.5'
  UNION ALL SELECT 'all_target_cells_have_parent', count(*) FILTER ((row // 2 + col // 2) % 37 = 0) FROM (FROM pixels UNION ALL FROM pixels WHERE (row + col) % 43 = 0) x
  UNION ALL SELECT 'no_future_ndvi', count(*) FILTER (d % 16 = 0) FROM f
  UNION ALL SELECT 'no_future_viirs', count(*) FILTER (d % 3 = 0) FROM f
  UNION ALL SELECT 'missing_is_null_not_nodata', count(*) FILTER (d = 4) FROM f)
SELECT "check", violations, violations = 0 AS passed FROM c
""")
def alignment_checks(spark, sf_dir):
    """Repeated cells and days, missing parents, look-ahead and nodata are planted; station days are clean."""
    d = F.dayofmonth("date")
    days = domain.cell_days(spark, sf_dir)
    feats = days.unionByName(days.where(d == 9)).select(
        F.concat_ws("_", "cell_row", "cell_col").alias("grid_id"), "date",
        F.when(d % 16 == 0, -1).otherwise(d).alias("ndvi_offset_days"), F.when(d % 3 == 0, -1).otherwise(1).alias("viirs_offset_days"),
        F.when(d == 4, -9999.0).otherwise(F.col("NDVI")).alias("value"))
    children = assign_parent(domain.pixels(spark, sf_dir), 2)
    parents = children.select(F.col("parent_row").alias("row"), F.col("parent_col").alias("col")).distinct().where(
        (F.col("row") + F.col("col")) % 37 != 0)
    children = children.unionByName(children.where((F.col("row") + F.col("col")) % 43 == 0))
    parents = parents.unionByName(parents.where((F.col("row") + F.col("col")) % 41 == 0))
    return RP.alignment_checks(feats, children, domain.daily(spark, sf_dir), parents)


# ----------------------------------------------------------------- leakage, gate

_LEAKY = [*FEATURES, "pm25_lag", "shadow"]


@query("leakage_suite", parts=["training"], sql=f"""
WITH p AS (
  SELECT station_id, CASE WHEN dayofmonth(date) <> 13 THEN date END AS date, longitude, latitude, dayofmonth(date) AS d,
    CASE WHEN dayofmonth(date) = 5 THEN 'Sample_' || country ELSE country END AS country
  FROM (SELECT * FROM training UNION ALL SELECT * FROM training WHERE dayofmonth(date) = 7) t),
c AS (
  SELECT 'target_leakage' AS "check", count(*) FILTER (regexp_matches(lower(f), 'pm25|target|aqi|concentration')) AS violations
    FROM (SELECT unnest({_LEAKY!r}) AS f) x
  UNION ALL SELECT 'duplicate_station_date', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM p GROUP BY station_id, date) x
  UNION ALL SELECT 'future_information', count(*) FILTER (date IS NULL OR d = 11) FROM p
  UNION ALL SELECT 'same_group_in_train_and_test', count(*) FROM (
    SELECT station_id, g.range FROM p, range(3) g GROUP BY 1, 2 HAVING bool_or(d % 3 = g.range) AND bool_or(d % 3 <> g.range)) x
  UNION ALL SELECT 'features_from_target', sum(CASE WHEN n > 0 AND n = same THEN 1 ELSE 0 END)::BIGINT FROM (
    SELECT f, count(v) AS n, count(*) FILTER (v = t) AS same FROM (
      SELECT "PM2.5" AS t, unnest(['pm25_lag', 'shadow', 'AOD', 'NDVI']) AS f, unnest(["PM2.5", "PM2.5", "AOD", "NDVI"]) AS v FROM training) x
    WHERE v IS NOT NULL AND t IS NOT NULL GROUP BY f) x
  UNION ALL SELECT 'synthetic_contamination', count(*) FILTER (country LIKE 'Sample_%') FROM p
  UNION ALL SELECT 'scope_contamination', count(*) FILTER (longitude BETWEEN 77.0 AND 77.4 AND latitude BETWEEN 28.4 AND 28.8) FROM p)
SELECT "check", violations, CASE WHEN "check" = 'synthetic_contamination' THEN CASE WHEN violations > 0 THEN 'PRESENT' ELSE 'NONE' END
  WHEN violations > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM c
""")
def leakage_suite(spark, sf_dir):
    """A table in which every kind of leak is planted; the clean one is in the tests."""
    t = domain.written_training(spark, sf_dir)
    d = F.dayofmonth("date")
    target = F.col(f"`{TARGET}`")
    bad = t.unionByName(t.where(d == 7)).withColumns({"pm25_lag": target, "shadow": target, "_d": d}).withColumns({
        "country": F.when(F.col("_d") == 5, F.concat(F.lit("Sample_"), "country")).otherwise(F.col("country")),
        "NDVI_source_date": F.date_add("date", F.when(F.col("_d") == 11, 1).otherwise(-3)),
        "date": F.when(F.col("_d") != 13, F.col("date"))})
    splits = FO.split_rows(bad.select("station_id", (F.col("_d") % 3).alias("fold")), 3)
    return L.leakage_suite(bad, features=_LEAKY, splits=splits)


@query("scope_contamination", parts=["obs"], sql="""
SELECT count(*) FILTER (longitude BETWEEN 77.0::DOUBLE AND 77.4::DOUBLE AND latitude BETWEEN 28.4::DOUBLE AND 28.8::DOUBLE) AS rows_inside FROM obs
""")
def scope_contamination(spark, sf_dir):
    return L.scope_contamination(domain.observations(spark, sf_dir), "india")


@query("synthetic_marker_scan", sql="""
SELECT 'city' AS "column", city AS value, count(*) AS n_rows FROM (
  SELECT CASE WHEN o_custkey % 11 = 0 THEN 'Sample_' || (o_custkey % 3) WHEN o_custkey % 13 = 0 THEN 'x_TEST' ELSE 'city' END AS city FROM orders) x
WHERE lower(city) LIKE '%sample\\_%' ESCAPE '\\' OR lower(city) LIKE '%\\_test%' ESCAPE '\\' GROUP BY 2
""")
def synthetic_marker_scan(spark, sf_dir):
    k = F.col("o_custkey")
    rows = domain.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("station_id"), F.lit("India").alias("country"),
        F.when(k % 11 == 0, F.concat(F.lit("Sample_"), (k % 3).cast("string")))
        .when(k % 13 == 0, "x_TEST").otherwise("city").alias("city"))
    return L.synthetic_marker_scan(rows, ["station_id", "country", "city"])


@query("model_input_violations", parts=["training"], sql="""
SELECT 0::BIGINT AS missing_target, count(*) FILTER ("AOD" IS NULL OR "NDVI" IS NULL OR temperature_c IS NULL) AS non_finite_features,
  count(DISTINCT station_id) AS groups, 0::BIGINT AS duplicate_keys FROM training
""")
def model_input_violations(spark, sf_dir):
    return L.model_input_violations(domain.training(spark, sf_dir), ["AOD", "NDVI", "temperature_c"],
                                    TARGET, "station_id")


_GATE = """
q AS (SELECT quantile_cont("PM2.5", 0.25) AS q1, quantile_cont("PM2.5", 0.75) AS q3 FROM training),
m AS (SELECT count(*) FILTER (complete_case) AS complete, count(DISTINCT station_id) AS stations, count(DISTINCT country) AS countries,
  count(DISTINCT date) AS days, least(count(DISTINCT latitude) - 3, count(DISTINCT longitude) - 3) AS pos,
  100.0::DOUBLE * count(DISTINCT date) / greatest(max(date) - min(date) + 1, 1) AS completeness,
  count(*) FILTER ("PM2.5" IS NULL) / count(*)::DOUBLE AS missing,
  count(*) FILTER ("PM2.5" < q1 - (q3 - q1) * 3 OR "PM2.5" > q3 + (q3 - q1) * 3) / count("PM2.5")::DOUBLE AS outl,
  100.0::DOUBLE * count("PM2.5") / count(*) AS c1, 100.0::DOUBLE * count("AOD") / count(*) AS c2,
  100.0::DOUBLE * count(*) FILTER (temperature_c IS NOT NULL AND relative_humidity_pct IS NOT NULL AND wind_speed_mps IS NOT NULL AND wind_direction_deg IS NOT NULL) / count(*) AS c3,
  100.0::DOUBLE * count("NDVI") / count(*) AS c4, 100.0::DOUBLE * count(elevation_m) / count(*) AS c5,
  100.0::DOUBLE * count(road_density) / count(*) AS c6, 100.0::DOUBLE * count(night_lights) / count(*) AS c7 FROM training, q),
s AS (SELECT *, CAST(c1 >= 80 AS INT) + CAST(c2 >= 40 AS INT) + CAST(c3 >= 40 AS INT) + CAST(c4 >= 30 AS INT) + CAST(c5 >= 50 AS INT)
  + CAST(c6 >= 50 AS INT) + CAST(c7 >= 30 AS INT) AS ready FROM m),
g AS (
  SELECT 'complete_case_rows' AS c, TRUE AS gating, complete::DOUBLE AS v, 1000::DOUBLE AS t, complete >= 1000 AS p FROM s
  UNION ALL SELECT 'stations', TRUE, stations, 20, stations >= 20 FROM s UNION ALL SELECT 'countries', TRUE, countries, 5, countries >= 5 FROM s
  UNION ALL SELECT 'temporal_days', TRUE, days, 30, days >= 30 FROM s UNION ALL SELECT 'spatial_coverage', TRUE, pos, 0, pos >= 0 FROM s
  UNION ALL SELECT 'temporal_coverage', TRUE, completeness, 50, completeness >= 50 FROM s
  UNION ALL SELECT 'missing_target', TRUE, missing, 0.05::DOUBLE, missing <= 0.05 FROM s UNION ALL SELECT 'outliers', TRUE, outl, 0.1::DOUBLE, outl <= 0.1 FROM s
  UNION ALL SELECT 'feature_sources_ready', TRUE, ready, 7, ready >= 7 FROM s UNION ALL SELECT 'data_freshness', TRUE, NULL, 1, TRUE FROM s
  UNION ALL SELECT 'source_pm25', FALSE, c1, 80, c1 >= 80 FROM s UNION ALL SELECT 'source_aod', FALSE, c2, 40, c2 >= 40 FROM s
  UNION ALL SELECT 'source_weather', FALSE, c3, 40, c3 >= 40 FROM s UNION ALL SELECT 'source_ndvi', FALSE, c4, 30, c4 >= 30 FROM s
  UNION ALL SELECT 'source_dem', FALSE, c5, 50, c5 >= 50 FROM s UNION ALL SELECT 'source_osm', FALSE, c6, 50, c6 >= 50 FROM s
  UNION ALL SELECT 'source_viirs', FALSE, c7, 30, c7 >= 30 FROM s)
"""


@query("readiness_checks", parts=["training"], sql=f"""
WITH {_GATE} SELECT c AS "check", gating, ROUND(v, 6) AS measured, t AS threshold, p AS passed FROM g
""")
def readiness_checks(spark, sf_dir):
    return rounded(RE.readiness_checks(domain.written_training(spark, sf_dir)).drop("reason"), "measured")


@query("readiness_verdict", parts=["training"], sql=f"""
WITH {_GATE}, h AS (SELECT CASE WHEN c IN ('missing_target', 'outliers') THEN 'quality_flags' ELSE c END AS c, min(p) AS p,
  max(c) FILTER (NOT p) AS failed FROM g WHERE gating GROUP BY 1)
SELECT CASE WHEN min(p) THEN 'YES' ELSE 'NO' END AS model_training_ready,
  ROUND(100.0::DOUBLE * count(*) FILTER (p) / count(*), 6) AS score, ROUND(100.0::DOUBLE * count(*) FILTER (p) / (count(*) + 1), 6) AS score_all,
  coalesce(string_agg(failed, '; ' ORDER BY failed), '') AS failed_checks FROM h
""")
def readiness_verdict(spark, sf_dir):
    return rounded(RE.readiness_verdict(RE.readiness_checks(domain.written_training(spark, sf_dir))), "score", "score_all")


# ------------------------------------------------------------------ uncertainty


def _residual_frame(spark, sf_dir):
    """Prediction stand-in: the mean of the station's country."""
    t = materialize(domain.training(spark, sf_dir).select("country", f"`{TARGET}`"), "targets")
    means = t.groupBy("country").agg(F.avg(f"`{TARGET}`").alias("predicted"))
    return t.join(means, "country")


_RES = """
r AS (SELECT t."PM2.5" - p.m AS e FROM training t JOIN (SELECT country, avg("PM2.5") AS m FROM training GROUP BY 1) p USING (country)),
ru AS (SELECT 'ESTIMATED' AS status, count(e) AS n_residuals, ROUND(sqrt(avg(e * e)), 2) AS rmse, ROUND(avg(abs(e)), 2) AS mae,
  ROUND(quantile_cont(e, 0.75) - quantile_cont(e, 0.25), 2) AS iqr FROM r),
gu AS (SELECT count(*) AS total_cells, count(*) FILTER (g > 0) AS cells_with_gaps, ROUND(avg(g * 100.0::DOUBLE / 9), 1) AS pct FROM (
  SELECT (""" + " + ".join(f"CAST({_q(f)} IS NULL AS INT)" for f in GRIDDED_FEATURES) + """) AS g FROM training) x),
du AS (SELECT count(*) AS n_cells, ROUND(quantile_cont(km, 0.5), 1) AS md, ROUND(max(km), 1) AS mx FROM (
  SELECT row, col, min(2.0::DOUBLE * 6371.0::DOUBLE * asin(sqrt(power(sin((radians(latitude) - radians(cy)) / 2), 2)
    + cos(radians(cy)) * cos(radians(latitude)) * power(sin((radians(longitude) - radians(cx)) / 2), 2)))) AS km
  FROM (SELECT r.range AS row, c.range AS col, 77.0::DOUBLE + c.range * 0.05::DOUBLE + 0.025::DOUBLE AS cx, 28.4::DOUBLE + r.range * 0.05::DOUBLE + 0.025::DOUBLE AS cy FROM range(9) r, range(9) c) g, stations
  GROUP BY 1, 2) y)
"""


def _distances(spark, sf_dir):
    cells = make_grid(spark, domain.STATION_GRID).select(
        "grid_id", F.col("cx").alias("longitude"), F.col("cy").alias("latitude"))
    return N.nearest_station(cells, domain.stations(spark, sf_dir), "grid_id", "station_id")


@query("residual_uncertainty", parts=["training", "stations"], sql=f"""
WITH {_RES} SELECT status, n_residuals, rmse AS rmse_ug_m3, mae AS mae_ug_m3, iqr AS iqr_ug_m3 FROM ru
""")
def residual_uncertainty(spark, sf_dir):
    return U.residual_uncertainty(_residual_frame(spark, sf_dir), TARGET, "predicted")


@query("feature_gap_uncertainty", parts=["training", "stations"], sql=f"""
WITH {_RES} SELECT total_cells, cells_with_gaps, pct AS mean_missing_features_pct, 'ESTIMATED' AS status FROM gu
""")
def feature_gap_uncertainty(spark, sf_dir):
    return U.feature_gap_uncertainty(domain.training(spark, sf_dir))


@query("distance_uncertainty", parts=["training", "stations"], sql=f"""
WITH {_RES} SELECT 'ESTIMATED' AS status, n_cells, md AS median_distance_to_station_km, mx AS max_distance_to_station_km FROM du
""")
def distance_uncertainty(spark, sf_dir):
    return U.distance_uncertainty(_distances(spark, sf_dir))


@query("uncertainty_score", parts=["training", "stations"], sql=f"""
WITH {_RES} SELECT 'ESTIMATED' AS status, 3::BIGINT AS n_components,
  ROUND((least(rmse / 100, 1.0::DOUBLE) * 100 + pct + least(mx / 50, 1.0::DOUBLE) * 100) / 3, 1) AS uncertainty_score FROM ru, gu, du
""")
def uncertainty_score(spark, sf_dir):
    return U.uncertainty_score(
        U.residual_uncertainty(_residual_frame(spark, sf_dir), TARGET, "predicted"),
        U.feature_gap_uncertainty(domain.training(spark, sf_dir)),
        U.distance_uncertainty(_distances(spark, sf_dir)))
