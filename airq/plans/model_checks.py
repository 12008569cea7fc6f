"""What holds of fitted models whatever the random draws: rows, folds, ranges and kept totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from airq.operators import downscale as DS, folds as FO, models as M
from airq.plans import modelling
from airq.plans.modelling import MODEL_FEATURES
from airq.plans.registry import day, query, r6
from airq.plans.sql_parts import part
from airq.schemas import TARGET
from airq.session import materialize

_COMPLETE = " AND ".join(f'"{c}" IS NOT NULL' for c in [TARGET, *MODEL_FEATURES])

part("complete", f"SELECT * FROM training WHERE {_COMPLETE}", "training")


@query("cross_validated_rows", parts=["complete"], sql="""
WITH RECURSIVE c AS (SELECT station_id, count(*) AS n FROM complete GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, station_id) AS i, row_number() OVER (ORDER BY station_id) - 1 AS alone,
  count(*) OVER () AS k FROM c),
g(i, loads, fold) AS (
  SELECT 0::BIGINT, list_transform(range(least(5, (SELECT count(*) FROM c))), lambda x: 0::BIGINT), -1::INT
  UNION ALL
  SELECT o.i, list_transform(g.loads, lambda x, k: CASE WHEN k = list_position(g.loads, list_min(g.loads)) THEN x + o.n ELSE x END),
    CAST(list_position(g.loads, list_min(g.loads)) - 1 AS INT) FROM g JOIN o ON o.i = g.i + 1),
f AS (SELECT station_id, CASE WHEN k <= 8 THEN CAST(alone AS INT) ELSE fold END AS fold FROM o JOIN g USING (i)),
p AS (SELECT complete.*, fold FROM complete JOIN f USING (station_id))
SELECT model, fold, count(*) AS rows, count(DISTINCT (station_id, date)) AS keys, count("PM2.5") AS predicted,
  count(DISTINCT station_id) AS stations,
  (SELECT count(*) FROM f AS x WHERE x.fold = p.fold AND x.station_id IN (SELECT station_id FROM f AS y WHERE y.fold <> p.fold)) AS trained_on,
  count(*) FILTER ("PM2.5" BETWEEN (SELECT min("PM2.5") FROM complete) AND (SELECT max("PM2.5") FROM complete)) AS in_range,
  ROUND(avg("PM2.5"), 6) AS mean_observed
FROM p CROSS JOIN (VALUES ('boosted'), ('forest')) m(model) GROUP BY model, fold
""")
def cross_validated_rows(spark, sf_dir):
    """Each row is predicted once a model, by a fit that met none of its station's rows.

    A forest's mean of leaf means stays inside the observed range; boosted sums may leave it, so they are held
    against the range widened by its own width.
    """
    train = modelling._train(spark, sf_dir)
    oof = materialize(M.grouped_cv(train, MODEL_FEATURES, "station_id", {
        "forest": lambda: M.forest(), "boosted": lambda: M.boosted_trees()}), "oof")
    homes = oof.select("model", "station_id", "fold").distinct().groupBy("model", "station_id").agg(
        F.count(F.lit(1)).alias("_folds"))
    ends = oof.agg(F.min("observed_PM25").alias("low"), F.max("observed_PM25").alias("high"))
    slack = F.when(F.col("model") == "boosted", F.col("_ends.high") - F.col("_ends.low")).otherwise(F.lit(1e-9))
    held = oof.join(homes, ["model", "station_id"]).withColumn("_ends", ends.select(F.struct("low", "high")).scalar())
    inside = F.col("predicted_PM25").between(F.col("_ends.low") - slack, F.col("_ends.high") + slack)
    return held.groupBy("model", "fold").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("station_id", "date").alias("keys"),
        F.count("predicted_PM25").alias("predicted"), F.countDistinct("station_id").alias("stations"),
        F.countDistinct(F.when(F.col("_folds") > 1, F.col("station_id"))).alias("trained_on"),
        F.count(F.when(inside, 1)).alias("in_range"), r6(F.avg("observed_PM25")).alias("mean_observed"))


@query("features_in_use", parts=["complete"], sql=" UNION ALL ".join(
    f"SELECT '{m}' AS model, '{f}' AS feature, count(DISTINCT \"{f}\") > 1 AS in_use FROM complete"
    for m in ("boosted", "forest") for f in MODEL_FEATURES))
def features_in_use(spark, sf_dir):
    """Features that a model splits on: with all its rounds, exactly those that vary; read back from a stored table."""
    train = modelling._train(spark, sf_dir)
    fitted = {"forest": M.fit(train, M.forest(), MODEL_FEATURES),
              "boosted": M.fit(train, M.boosted_trees(), MODEL_FEATURES)}
    stored = materialize(M.feature_importance(fitted, MODEL_FEATURES, spark), "importance")
    return stored.select("model", "feature", (F.col("relative_share") > 0).alias("in_use"))


_READY = " AND ".join(f'"{c}" IS NOT NULL' for c in [
    *MODEL_FEATURES[:2], "wind_speed_mps", "wind_direction_deg", *MODEL_FEATURES[4:-1]])


@query("predicted_cell_days", parts=["features_1km", "complete"], sql=f"""
SELECT CASE WHEN {_READY} THEN 'valid' ELSE 'missing_feature' END AS prediction_status, strftime(date, '%Y-%m-%d') AS date,
  count(*) AS cells, count(CASE WHEN {_READY} THEN 1 END) AS predicted,
  count(CASE WHEN {_READY} AND (SELECT count(*) FROM complete) > 0 THEN 1 END) AS in_range
FROM features_1km GROUP BY 1, 2
""")
def predicted_cell_days(spark, sf_dir):
    """All cell-days after prediction: which have a value, and that no value leaves the range of the training target."""
    train = modelling._train(spark, sf_dir)
    model = M.fit(train, M.forest(), MODEL_FEATURES)
    out = M.predict_cells(model, modelling._cell_features(spark, sf_dir), MODEL_FEATURES, ["cell_row", "cell_col", "date"])
    ends = train.where(M.all_present([TARGET, *MODEL_FEATURES])).agg(
        F.min(f"`{TARGET}`").alias("low"), F.max(f"`{TARGET}`").alias("high"))
    held = out.withColumn("_ends", ends.select(F.struct("low", "high")).scalar())
    inside = F.col("raw_predicted_PM25").between(F.col("_ends.low") - 1e-9, F.col("_ends.high") + 1e-9)
    return held.groupBy("prediction_status", day("date")).agg(
        F.count(F.lit(1)).alias("cells"), F.count("predicted_PM25").alias("predicted"),
        F.count(F.when(inside, 1)).alias("in_range"))


@query("refined_parents", parts=["children"], sql="""
WITH s AS (SELECT *, CASE WHEN parent_pm25 IS NULL THEN 'missing_parent'
    WHEN child IS NULL OR discount IS NULL OR value IS NULL OR price IS NULL THEN 'missing_feature' ELSE 'downscaled_residual' END AS status FROM children),
p AS (SELECT parent_row, parent_col, max(parent_pm25) AS p, count(*) FILTER (status = 'downscaled_residual') AS n FROM s GROUP BY 1, 2)
SELECT status, count(*) AS cells, count(*) FILTER (status = 'downscaled_residual') AS with_value,
  count(DISTINCT (parent_row, parent_col)) FILTER (n > 0) AS kept_parents,
  ROUND(sum(CASE WHEN n > 0 AND status = 'downscaled_residual' THEN area_km2 END), 6) AS area_km2
FROM s JOIN p USING (parent_row, parent_col) GROUP BY status
""")
def refined_parents(spark, sf_dir):
    """Children after the residual forest: their status, and the parents whose mean the children keep."""
    out = materialize(modelling._refined(spark, sf_dir), "refined")
    keys = ["parent_row", "parent_col"]
    means = DS.parent_means(out, keys, "pm25_final", "area_km2")
    kept = F.abs(F.col("child_mean") - F.col("parent_pm25")) < 1e-6
    return out.join(means, keys).groupBy(F.col("prediction_status").alias("status")).agg(
        F.count(F.lit(1)).alias("cells"), F.count("pm25_final").alias("with_value"),
        F.countDistinct(F.when(kept, F.struct(*keys))).alias("kept_parents"),
        r6(F.sum(F.when(F.col("pm25_final").isNotNull(), F.col("area_km2")))).alias("area_km2"))
