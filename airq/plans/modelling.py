"""Queries on folds, metrics, models, downscaling and parent consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from airq.operators import downscale as DS, features as FT, folds as FO, models as M
from airq.operators import reports as RP
from airq.operators.grid import assign_cell, assign_parent
from airq.plans.registry import day, query, r6, rounded
from airq.plans.sql_parts import part
from airq.schemas import RESIDUAL_FEATURES, TARGET
from airq.session import materialize
from airq.sources import domain

MODEL_FEATURES = ["temperature_c", "relative_humidity_pct", "wind_u_mps", "wind_v_mps", "NDVI",
                  "elevation_m", "road_density", "night_lights", "day_of_year"]


@query("fold_index", sql="""
SELECT n_name AS country, CAST(row_number() OVER (ORDER BY n_name) - 1 AS INT) AS fold
FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey)
""")
def fold_index(spark, sf_dir):
    """Leave-one-country-out numbers of the countries that ship anything."""
    t = lambda n: domain.table(spark, sf_dir, n)
    rows = (t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("n_name").alias("country")))
    return FO.fold_index(rows, "country")


@query("country_splits", parts=["training"], sql="""
WITH f AS (SELECT country, row_number() OVER (ORDER BY country) - 1 AS fold FROM (SELECT DISTINCT country FROM training) x),
n AS (SELECT count(*) AS k FROM f)
SELECT CAST(g.range AS INT) AS fold, CASE WHEN f.fold = g.range THEN 'test' ELSE 'train' END AS split, count(*) AS rows,
  count(DISTINCT t.country) AS groups,
  (SELECT count(*) FROM f AS x JOIN f AS y ON x.country = y.country AND x.fold <> y.fold) AS overlapping_groups
FROM training t JOIN f USING (country) CROSS JOIN range((SELECT k FROM n)) g GROUP BY 1, 2
""")
def country_splits(spark, sf_dir):
    """Rows and groups of both sides of every fold, with the number of groups on both sides."""
    rows = materialize(domain.training(spark, sf_dir).select("country", "station_id", "date"), "rows")
    folded = FO.assign_folds(rows, "country", "leave_one_group_out")
    sizes = materialize(FO.split_sizes(folded, "country"), "splits")
    bad = sizes.where("split = 'test'").agg(F.coalesce(F.sum("shared"), F.lit(0)).alias("n"))
    return sizes.drop("shared").withColumn("overlapping_groups", bad.scalar())


@query("splits_by_day", parts=["training"], sql="""
WITH t AS (SELECT station_id, CAST(dayofyear(date) % 5 AS INT) AS own FROM training),
s AS (SELECT CAST(g.range AS INT) AS fold, CASE WHEN own = g.range THEN 'test' ELSE 'train' END AS split, station_id FROM t CROSS JOIN range(5) g
  WHERE g.range IN (SELECT own FROM t)),
b AS (SELECT fold, station_id FROM s GROUP BY 1, 2 HAVING count(DISTINCT split) = 2)
SELECT fold, split, count(*) AS rows, count(DISTINCT station_id) AS groups, (SELECT count(*) FROM b WHERE b.fold = s.fold) AS shared FROM s GROUP BY 1, 2
""")
def splits_by_day(spark, sf_dir):
    """Folds by day that pay no heed to stations: how many stations are on both sides."""
    rows = domain.training(spark, sf_dir).select("station_id", (F.dayofyear("date") % 5).cast("int").alias("fold"))
    return FO.split_sizes(rows, "station_id")


@query("balanced_station_folds", parts=["training"], sql="""
WITH RECURSIVE c AS (SELECT station_id, count(*) AS n FROM training GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, station_id) AS i FROM c),
g(i, loads, fold, n) AS (
  SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], -1::INT, 0::BIGINT
  UNION ALL
  SELECT o.i, list_transform(g.loads, lambda x, k: CASE WHEN k = list_position(g.loads, list_min(g.loads)) THEN x + o.n ELSE x END),
    CAST(list_position(g.loads, list_min(g.loads)) - 1 AS INT), o.n FROM g JOIN o ON o.i = g.i + 1)
SELECT fold, CAST(sum(n) AS BIGINT) AS rows, count(*) AS stations FROM g WHERE i > 0 GROUP BY 1
""")
def balanced_station_folds(spark, sf_dir):
    """Stations dealt to five folds, largest first into the lightest fold."""
    rows = domain.training(spark, sf_dir).select("station_id", "date")
    return FO.assign_folds(rows, "station_id").groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("station_id").alias("stations"))


part("oof", """
SELECT 'mean' AS model, r_name AS fold, "PM2.5" AS y, m AS p FROM training
JOIN (SELECT country, avg("PM2.5") AS m FROM training GROUP BY 1) a USING (country)
JOIN nation ON n_name = country JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT 'weather', r_name, "PM2.5", temperature_c + relative_humidity_pct / 10.0::DOUBLE FROM training
JOIN nation ON n_name = country JOIN region ON n_regionkey = r_regionkey WHERE temperature_c IS NOT NULL
""", "training")


def _oof(spark, sf_dir):
    """Two simple predictors scored per region."""
    t = materialize(domain.training(spark, sf_dir).select(
        "country", f"`{TARGET}`", "temperature_c", "relative_humidity_pct"), "scored")
    nation, region = (domain.table(spark, sf_dir, n) for n in ("nation", "region"))
    names = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("country"), F.col("r_name").alias("fold"))
    y = F.col(f"`{TARGET}`").alias("observed_PM25")
    means = t.groupBy("country").agg(F.avg(f"`{TARGET}`").alias("predicted_PM25"))
    rows = t.join(names, "country")
    one = rows.join(means, "country").select(F.lit("mean").alias("model"), "fold", y, "predicted_PM25")
    two = rows.where(F.col("temperature_c").isNotNull()).select(
        F.lit("weather").alias("model"), "fold", y,
        (F.col("temperature_c") + F.col("relative_humidity_pct") / 10.0).alias("predicted_PM25"))
    return one.unionByName(two)


_FOLD = """fm AS (SELECT model, fold, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
  CASE WHEN count(*) >= 3 AND var_pop(y) > 0 THEN 1.0::DOUBLE - sum((y - p) * (y - p)) / (count(*) * var_pop(y)) END AS r2 FROM oof GROUP BY 1, 2)"""


@query("fold_metrics", parts=["oof"], sql=f"""
WITH {_FOLD} SELECT model, fold, n, ROUND(mae, 5) AS mae, ROUND(rmse, 5) AS rmse, ROUND(r2, 5) AS r2 FROM fm
""")
def fold_metrics(spark, sf_dir):
    return rounded(FO.fold_metrics(_oof(spark, sf_dir), ["model", "fold"]), "mae", "rmse", "r2", digits=5)


@query("aggregate_metrics", parts=["oof"], sql=f"""
WITH {_FOLD}, p AS (SELECT model, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
  1.0::DOUBLE - sum((y - p) * (y - p)) / (count(*) * var_pop(y)) AS r2 FROM oof GROUP BY 1)
SELECT model, ROUND(avg(fm.mae), 5) AS mean_fold_mae, ROUND(avg(fm.rmse), 5) AS mean_fold_rmse, ROUND(avg(fm.r2), 5) AS mean_fold_r2,
  count(fm.r2) AS valid_r2_folds, count(*) - count(fm.r2) AS r2_undefined_folds, ROUND(any_value(p.mae), 5) AS pooled_oof_mae,
  ROUND(any_value(p.rmse), 5) AS pooled_oof_rmse, ROUND(any_value(p.r2), 5) AS pooled_oof_r2, any_value(p.r2) >= 0.5 AS validated
FROM fm JOIN p USING (model) GROUP BY model
""")
def aggregate_metrics(spark, sf_dir):
    out = FO.aggregate_metrics(_oof(spark, sf_dir))
    return rounded(out, "mean_fold_mae", "mean_fold_rmse", "mean_fold_r2", "pooled_oof_mae",
                   "pooled_oof_rmse", "pooled_oof_r2", digits=5)


def _train(spark, sf_dir):
    return domain.written_training(spark, sf_dir)


@query("grouped_cross_validation")
def grouped_cross_validation(spark, sf_dir):
    """Forest and boosted trees on station folds; random draws have no SQL form."""
    oof = M.grouped_cv(_train(spark, sf_dir), MODEL_FEATURES, "station_id", {
        "forest": lambda: M.forest(), "boosted": lambda: M.boosted_trees()})
    return rounded(FO.aggregate_metrics(oof), "mean_fold_mae", "mean_fold_rmse", "mean_fold_r2",
                   "pooled_oof_mae", "pooled_oof_rmse", "pooled_oof_r2", digits=4)


@query("feature_importance")
def feature_importance(spark, sf_dir):
    train = _train(spark, sf_dir)
    fitted = {"forest": M.fit(train, M.forest(), MODEL_FEATURES),
              "boosted": M.fit(train, M.boosted_trees(), MODEL_FEATURES)}
    return rounded(M.feature_importance(fitted, MODEL_FEATURES, spark), "importance", "relative_share")


def _cell_features(spark, sf_dir):
    from airq.functions.met import temporal_features, wind_u, wind_v
    cells = domain.features_1km(spark, sf_dir).withColumns({
        "wind_u_mps": wind_u(F.col("wind_speed_mps"), F.col("wind_direction_deg")),
        "wind_v_mps": wind_v(F.col("wind_speed_mps"), F.col("wind_direction_deg"))})
    return cells.withColumns(temporal_features(F.col("date")))


@query("predicted_cells")
def predicted_cells(spark, sf_dir):
    """Predictions of all cell-days; cells with gaps stay without a value."""
    model = M.fit(_train(spark, sf_dir), M.forest(), MODEL_FEATURES)
    out = M.predict_cells(model, _cell_features(spark, sf_dir), MODEL_FEATURES,
                          ["cell_row", "cell_col", "date"])
    return out.groupBy("prediction_status", day("date")).agg(
        F.count(F.lit(1)).alias("cells"), r6(F.avg("predicted_PM25")).alias("mean_pm25"))


part("coarse", """
SELECT cell_row, cell_col, date, CASE WHEN "AOD" IS NOT NULL THEN greatest(temperature_c * 2.0::DOUBLE - 30.0::DOUBLE, 0.0::DOUBLE) END AS pred,
  CASE WHEN "AOD" IS NOT NULL THEN 'valid' ELSE 'missing_feature' END AS prediction_status FROM cell_days
""", "cell_days")


def _coarse(spark, sf_dir):
    """Prediction stand-in with gaps and clipping."""
    from airq.functions.status import clip_negative, prediction_status_coarse
    has = F.col("AOD").isNotNull()
    return domain.cell_days(spark, sf_dir).withColumns({
        "predicted_PM25": clip_negative(F.when(has, F.col("temperature_c") * 2.0 - 30.0)),
        "prediction_status": prediction_status_coarse(["AOD"])}).select(
        "cell_row", "cell_col", "date", "predicted_PM25", "prediction_status")


@query("inference_report", parts=["coarse"], sql="""
SELECT strftime(date, '%Y-%m-%d') AS date, count(*) AS total_cells, count(pred) AS valid_cells, count(*) - count(pred) AS nodata_cells,
  ROUND(100.0::DOUBLE * count(pred) / count(*), 6) AS coverage_percent, ROUND(min(pred), 6) AS min, ROUND(max(pred), 6) AS max, ROUND(avg(pred), 6) AS mean
FROM coarse GROUP BY 1
""")
def inference_report(spark, sf_dir):
    """The report per day; the day is part of the grouping of one aggregate."""
    p = F.col("predicted_PM25")
    days = _coarse(spark, sf_dir).groupBy(day("date"))
    out = days.agg(F.count(F.lit(1)).alias("total_cells"), F.count(p).alias("valid_cells"),
                   F.count(F.when(p.isNull(), 1)).alias("nodata_cells"),
                   (F.lit(100.0) * F.count(p) / F.count(F.lit(1))).alias("coverage_percent"),
                   F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("mean"))
    return rounded(out, "coverage_percent", "min", "max", "mean")


@query("inference_totals", parts=["coarse"], sql="""
SELECT count(*) AS total_cells, count(pred) AS valid_cells, count(*) - count(pred) AS nodata_cells,
  ROUND(100.0::DOUBLE * count(pred) / count(*), 6) AS coverage_percent, ROUND(min(pred), 6) AS min, ROUND(max(pred), 6) AS max, ROUND(avg(pred), 6) AS mean FROM coarse
""")
def inference_totals(spark, sf_dir):
    return rounded(RP.inference_report(_coarse(spark, sf_dir)), "coverage_percent", "min", "max", "mean")


@query("prediction_status_counts", parts=["coarse"], sql="""
SELECT prediction_status, count(*) AS n_cells FROM coarse GROUP BY 1
""")
def prediction_status_counts(spark, sf_dir):
    return RP.prediction_status_counts(_coarse(spark, sf_dir))


part("placed", """
SELECT *, CAST(floor((latitude - 28.4::DOUBLE) / 0.05::DOUBLE) AS BIGINT) AS cell_row,
  CAST(floor((longitude - 77.0::DOUBLE) / 0.05::DOUBLE) AS BIGINT) AS cell_col FROM daily
""", "daily")


@query("predicted_vs_observed", parts=["placed", "coarse"], sql="""
SELECT count(pred) AS n_station_cells_matched, ROUND(avg(abs(pm25_daily - pred)), 6) AS station_mae FROM placed LEFT JOIN coarse USING (cell_row, cell_col, date)
""")
def predicted_vs_observed(spark, sf_dir):
    obs = assign_cell(domain.daily(spark, sf_dir).withColumnRenamed("pm25_daily", TARGET),
                      domain.STATION_GRID, "longitude", "latitude")
    return rounded(FT.predicted_vs_observed(obs, _coarse(spark, sf_dir), ["cell_row", "cell_col", "date"]),
                   "station_mae")


@query("residual_training_table", parts=["placed", "coarse", "features_1km"], sql="""
SELECT station_id, strftime(p.date, '%Y-%m-%d') AS date, ROUND(pm25_daily - pred, 6) AS residual_pm25
FROM placed p JOIN coarse c ON c.cell_row = p.cell_row AND c.cell_col = p.cell_col AND c.date = p.date
JOIN features_1km f ON f.cell_row = p.cell_row AND f.cell_col = p.cell_col AND f.date = p.date
WHERE pred IS NOT NULL AND "NDVI" IS NOT NULL AND elevation_m IS NOT NULL AND road_density IS NOT NULL AND night_lights IS NOT NULL
""")
def residual_training_table(spark, sf_dir):
    return _residual_rows(spark, sf_dir).select("station_id", day("date"), r6("residual_pm25").alias("residual_pm25"))


def _residual_rows(spark, sf_dir):
    keys = ["cell_row", "cell_col", "date"]
    obs = assign_cell(domain.daily(spark, sf_dir).withColumnRenamed("pm25_daily", TARGET),
                      domain.STATION_GRID, "longitude", "latitude")
    train = obs.join(domain.features_1km(spark, sf_dir), keys)
    return DS.residual_training_table(train, _coarse(spark, sf_dir), keys)


part("children", """
SELECT c.*, p.parent_pm25, 0.0625::DOUBLE * (1 + c.col % 3) AS area_km2 FROM (
  SELECT row, col, row // 2 AS parent_row, col // 2 AS parent_col, CASE WHEN qa <> 6 THEN value - 5.0::DOUBLE END AS child, discount, value, price FROM pixels) c
LEFT JOIN (SELECT row // 2 AS parent_row, col // 2 AS parent_col, avg(price) / 1000.0::DOUBLE AS parent_pm25 FROM pixels WHERE qa < 5 GROUP BY 1, 2) p USING (parent_row, parent_col)
""", "pixels")


def _children(spark, sf_dir):
    px = assign_parent(domain.written_pixels(spark, sf_dir), 2)
    parents = px.where(F.col("qa") < 5).groupBy("parent_row", "parent_col").agg(
        (F.avg("price") / 1000.0).alias("parent_pm25"))
    return px.join(parents, ["parent_row", "parent_col"], "left").select(
        "row", "col", "parent_row", "parent_col", "parent_pm25",
        F.when(F.col("qa") != 6, F.col("value") - 5.0).alias("child"),
        (F.lit(0.0625) * (F.col("col") % 3 + 1)).alias("area_km2"), "discount", "value", "price")


_BASE = """
b AS (SELECT *, CASE WHEN parent_pm25 IS NULL THEN 'missing_parent' ELSE 'baseline_prototype' END AS status, CASE WHEN parent_pm25 IS NOT NULL THEN greatest(parent_pm25, 0.0::DOUBLE) END AS final FROM children)
"""


@query("downscale_baseline", parts=["children"], sql=f"""
WITH {_BASE} SELECT status, count(*) AS cells, ROUND(avg(final), 6) AS mean_pm25 FROM b GROUP BY 1
""")
def downscale_baseline(spark, sf_dir):
    """Without a residual model children take the parent's value."""
    out = DS.downscale(_children(spark, sf_dir), None)
    return out.groupBy(F.col("prediction_status").alias("status")).agg(
        F.count(F.lit(1)).alias("cells"), r6(F.avg("pm25_final")).alias("mean_pm25"))


_MEANS = """m AS (SELECT parent_row, parent_col, sum(area_km2 * child) / sum(CASE WHEN child IS NOT NULL THEN area_km2 END) AS cm FROM children GROUP BY 1, 2)"""


@query("parent_consistency", parts=["children"], sql=f"""
WITH {_MEANS} SELECT row, col, ROUND(child + (parent_pm25 - cm), 8) AS value, ROUND(parent_pm25 - cm, 8) AS consistency_shift
FROM children JOIN m USING (parent_row, parent_col)
""")
def parent_consistency(spark, sf_dir):
    out = DS.apply_parent_consistency(_children(spark, sf_dir), ["parent_row", "parent_col"], "child")
    return out.select("row", "col", r6("child", 8).alias("value"), r6("consistency_shift", 8).alias("consistency_shift"))


@query("parent_consistency_report", parts=["children"], sql="""
WITH p AS (SELECT parent_row, parent_col, sum(area_km2 * child) / sum(area_km2) AS m, max(parent_pm25) AS p FROM children WHERE child IS NOT NULL GROUP BY 1, 2)
SELECT count(*) AS n_parents_compared, ROUND(avg(abs(m - p)), 6) AS mean_abs_diff, ROUND(max(abs(m - p)), 6) AS max_abs_diff,
  ROUND(avg(CASE WHEN p <> 0 THEN abs(m - p) / abs(p) * 100.0::DOUBLE END), 6) AS mean_rel_diff_percent,
  count(*) FILTER (abs(m - p) > 1) AS n_parents_with_abs_diff_gt_1 FROM p
""")
def parent_consistency_report(spark, sf_dir):
    out = DS.parent_consistency_report(_children(spark, sf_dir), ["parent_row", "parent_col"], "child")
    return rounded(out, "mean_abs_diff", "max_abs_diff", "mean_rel_diff_percent")


def _refined(spark, sf_dir):
    """Residual forest, children predicted and shifted to their parents."""
    model = DS.fit_residual_model(_residual_rows(spark, sf_dir))
    kids = _children(spark, sf_dir).withColumns({
        "NDVI": F.when(F.col("child").isNotNull(), F.col("discount")), "elevation_m": F.col("value") * 10.0,
        "road_density": F.col("value"), "night_lights": F.col("price") / 1000.0})
    assert set(RESIDUAL_FEATURES) <= set(kids.columns)
    return DS.apply_parent_consistency(DS.downscale(kids, model), ["parent_row", "parent_col"])


@query("downscale_residual")
def downscale_residual(spark, sf_dir):
    return _refined(spark, sf_dir).groupBy("prediction_status").agg(
        F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("pm25_final") < 0, 1)).alias("negative_after_shift"),
        r6(F.avg("pm25_final")).alias("mean_pm25"))
