"""Refining coarse predictions: residual model and parent consistency."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame, functions as F

from airq.functions.status import all_present, clip_negative, prediction_status_fine
from airq.operators.models import fit, forest, with_vector
from airq.schemas import RESIDUAL_FEATURES, TARGET

MIN_RESIDUAL_ROWS = 20


def residual_training_table(train: DataFrame, coarse: DataFrame, keys: list[str],
                            features: list[str] | None = None) -> DataFrame:
    """Observed minus coarse prediction of the SAME cell and day, complete rows only."""
    features = features or RESIDUAL_FEATURES
    lookup = coarse.where(F.col("predicted_PM25").isNotNull()).select(
        *keys, F.col("predicted_PM25").alias("coarse_predicted_PM25"))
    joined = train.join(lookup, keys, "left").withColumn(
        "residual_pm25", F.col(f"`{TARGET}`") - F.col("coarse_predicted_PM25"))
    return joined.where(all_present([*features, "residual_pm25"]))


def fit_residual_model(rows: DataFrame, features: list[str] | None = None,
                       **overrides) -> Model | None:
    """Forest on the residuals, or None with too few rows."""
    features = features or RESIDUAL_FEATURES
    if len(rows.limit(MIN_RESIDUAL_ROWS).select(F.lit(1)).collect()) < MIN_RESIDUAL_ROWS:
        return None
    return fit(rows, forest(**overrides), features, "residual_pm25")


def downscale(children: DataFrame, model: Model | None, features: list[str] | None = None,
              parent_value: str = "parent_pm25") -> DataFrame:
    """Child value = parent value plus predicted residual, floored at zero."""
    features = features or RESIDUAL_FEATURES
    parent = F.col(parent_value)
    if model is None:
        out = children.withColumn("predicted_residual", F.lit(0.0))
    else:
        ready = model.transform(with_vector(children.where(all_present(features)), features))
        done = ready.withColumnRenamed("_prediction", "predicted_residual").drop("_features")
        rest = children.where(~all_present(features)).withColumn(
            "predicted_residual", F.lit(None).cast("double"))
        out = done.unionByName(rest)
    raw = parent + F.col("predicted_residual")
    return out.withColumns({
        "pm25_raw": raw,
        "prediction_status": prediction_status_fine(parent, F.col("predicted_residual"),
                                                    model is not None),
    }).withColumn("pm25_final", clip_negative(F.col("pm25_raw")))


def parent_means(children: DataFrame, parent: list[str], value: str, area: str) -> DataFrame:
    """Area-weighted mean of the children that have a value, per parent."""
    usable = F.col(value).isNotNull()
    weight = F.when(usable, F.col(area))
    return children.groupBy(*parent).agg(
        (F.sum(weight * F.col(value)) / F.sum(weight)).alias("child_mean"))


def apply_parent_consistency(children: DataFrame, parent: list[str], value: str = "pm25_final",
                             parent_value: str = "parent_pm25", area: str = "area_km2") -> DataFrame:
    """Shift children so that their weighted mean equals the parent's value.

    Means are aggregated per parent and joined back; a parent's children are
    never gathered in one place.
    """
    means = parent_means(children, parent, value, area)
    out = children.join(means, parent, "left").withColumn(
        "consistency_shift", F.col(parent_value) - F.col("child_mean"))
    return out.withColumn(value, F.col(value) + F.col("consistency_shift")).drop("child_mean")


def parent_consistency_report(children: DataFrame, parent: list[str], value: str = "pm25_final",
                              parent_value: str = "parent_pm25", area: str = "area_km2") -> DataFrame:
    """Differences between the children's weighted mean and the parent's value."""
    valid = children.where(F.col(value).isNotNull())
    per = valid.groupBy(*parent).agg(
        (F.sum(F.col(area) * F.col(value)) / F.sum(area)).alias("m"),
        F.max(parent_value).alias("p"))
    diff = F.abs(F.col("m") - F.col("p"))
    return per.agg(
        F.count(F.lit(1)).alias("n_parents_compared"), F.avg(diff).alias("mean_abs_diff"),
        F.max(diff).alias("max_abs_diff"),
        F.avg(F.when(F.col("p") != 0, diff / F.abs("p") * 100.0)).alias("mean_rel_diff_percent"),
        F.count(F.when(diff > 1.0, 1)).alias("n_parents_with_abs_diff_gt_1"))
