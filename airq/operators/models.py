"""Regression models in Spark ML, grouped cross-validation and importance."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from airq.functions.status import all_present, clip_negative, prediction_status_coarse
from airq.operators.folds import assign_folds
from airq.schemas import TARGET
from airq.session import materialize, spread

# Model parameters of the pipeline's two regressors.
FOREST = {"numTrees": 200, "maxDepth": 6, "minInstancesPerNode": 2, "seed": 42}
BOOST = {"maxIter": 200, "maxDepth": 3, "stepSize": 0.05, "subsamplingRate": 0.8,
         "featureSubsetStrategy": "0.8", "seed": 42}
#: Weighted rows that stand for the rows of equal features, at most.
PIECES = 64


def forest(**overrides) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol="_label", featuresCol="_features",
                                 predictionCol="_prediction", **{**FOREST, **overrides})


def boosted_trees(**overrides) -> GBTRegressor:
    """Gradient-boosted trees; column sampling happens per node."""
    return GBTRegressor(labelCol="_label", featuresCol="_features",
                        predictionCol="_prediction", **{**BOOST, **overrides})


def with_vector(df: DataFrame, features: list[str]) -> DataFrame:
    """Assemble the features of rows that have them all."""
    return VectorAssembler(inputCols=features, outputCol="_features",
                           handleInvalid="error").transform(df)


def _takes_means(estimator: Estimator) -> bool:
    """Whether rows of equal features may be one row of their mean and weight: squared loss, so splits and leaves stay the same."""
    squared = isinstance(estimator, GBTRegressor) and estimator.getLossType() == "squared"
    return squared or isinstance(estimator, RandomForestRegressor)


def merge_equal(rows: DataFrame, features: list[str], by: list[str] | None = None, pieces: int = PIECES) -> DataFrame:
    """(by, features, _label, _weight): all rows, those of equal features in at most ``pieces`` weighted means.

    Places of one cell and day share all features, so their rows differ in the label only. Features (within ``by``) that
    occur up to ``pieces`` times keep their rows; others are dealt to pieces by a hash of the whole row. Without
    sampling, a tree grown on the means and weights is the tree of the rows: the squares that a mean leaves out lie
    on one side of every split. Bootstrap and subsample draw pieces instead of rows, where there are more.
    """
    keys = [*(by or []), *[f"`{f}`" for f in features]]
    whole = [f"`{f.name}`" for f in rows.schema if "map<" not in f.dataType.simpleString()]
    rows = rows.withColumn("_piece", F.pmod(F.xxhash64(*whole), F.lit(pieces)))
    crowded = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > pieces), "crowded")
    marked = rows.join(crowded, [*(by or []), *features], "left")
    few = marked.where("_n is null").select(*keys, "_label", F.lit(1.0).alias("_weight"))
    many = marked.where("_n is not null").groupBy(*keys, "_piece").agg(
        F.avg("_label").alias("_label"), F.count(F.lit(1)).cast("double").alias("_weight"))
    return few.unionByName(many.drop("_piece"))


def _fitted(estimator: Estimator, rows: DataFrame) -> Model:
    if "_weight" in rows.columns:
        estimator = estimator.copy({estimator.getParam("weightCol"): "_weight"})
    # Each level of each tree is a pass over the rows.
    return estimator.fit(spread(rows))


def fit(df: DataFrame, estimator: Estimator, features: list[str], target: str = TARGET) -> Model:
    """The estimator fitted to the rows that have the target and all features."""
    ready = df.where(all_present([target, *features])).withColumn("_label", F.col(f"`{target}`"))
    if not _takes_means(estimator):
        return _fitted(estimator, with_vector(ready, features).select("_label", "_features"))
    merged = materialize(merge_equal(ready, features), "merged")
    return _fitted(estimator, with_vector(merged, features).select("_label", "_features", "_weight"))


def grouped_cv(df: DataFrame, features: list[str], group: str,
               estimators: dict[str, Callable[[], Estimator]], target: str = TARGET,
               strategy: str = "auto", k: int = 5, keep: list[str] | None = None,
               parallelism: int = 4) -> DataFrame:
    """Out-of-fold predictions of every model, one fit per fold and model.

    No group is ever in train and test of one fold, because a fold is a set of
    whole groups. Returns model, fold, the kept columns, observed_PM25,
    predicted_PM25 and residual. The folded rows and the predictions of each
    fold are stored tables, so a lost executor costs no fit. ``parallelism`` fits
    run at the same time: a boosted fit is a long row of small jobs, which leave
    most executors idle. More of them hold more copies of the training rows.
    Models of squared loss are fitted to :func:`merge_equal` rows of each fold,
    which are made once; every row is predicted.
    """
    keep = keep or [group, "date"]
    dealt = assign_folds(df.where(all_present([target, *features])), group, strategy, k)
    dealt = materialize(dealt.withColumn("_label", F.col(f"`{target}`")).select(
        *dict.fromkeys([*keep, "fold", "_label", *features])), "folded")
    ready = with_vector(dealt, features).select(*keep, "fold", "_label", "_features")
    folds = [r["fold"] for r in ready.select("fold").distinct().orderBy("fold").collect()]
    if len(folds) < 2:
        raise ValueError("cross-validation needs at least two groups")
    merged = materialize(merge_equal(dealt, features, ["fold"], math.ceil(PIECES / (len(folds) - 1))), "merged")
    merged = with_vector(merged, features).select("fold", "_label", "_features", "_weight")

    def predicted(fold: int, name: str) -> DataFrame:
        estimator = estimators[name]()
        train, test = merged if _takes_means(estimator) else ready, ready.where(F.col("fold") == fold)
        model = _fitted(estimator, train.where(F.col("fold") != fold).drop("fold", *keep))
        return materialize(model.transform(test).select(
            F.lit(name).alias("model"), "fold", *keep, F.col("_label").alias("observed_PM25"),
            F.col("_prediction").alias("predicted_PM25")), "predictions")

    # Long fits first, so that none is left alone at the end.
    names = sorted(estimators, key=lambda name: estimators[name]().hasParam("maxIter"), reverse=True)
    wanted = [(fold, name) for name in names for fold in folds]
    with ThreadPool(min(parallelism, len(wanted))) as pool:
        parts = pool.starmap(inheritable_thread_target(df.sparkSession)(predicted), wanted, chunksize=1)
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("residual", F.col("observed_PM25") - F.col("predicted_PM25"))


def feature_importance(models: dict[str, Model], features: list[str], spark) -> DataFrame:
    """(model, feature, importance, relative_share), bounded by the feature list."""
    rows = [(name, f, float(v)) for name, m in models.items()
            for f, v in zip(features, m.featureImportances.toArray())]
    table = spark.createDataFrame(rows, "model string, feature string, importance double")
    totals = table.groupBy("model").agg(F.sum("importance").alias("_t"))
    return table.join(totals, "model").withColumn(
        "relative_share", F.col("importance") / F.greatest(F.col("_t"), F.lit(1e-12))
    ).drop("_t").orderBy("model", F.desc("importance"))


def predict_cells(model: Model, cells: DataFrame, features: list[str],
                  keep: list[str]) -> DataFrame:
    """Predict where all features exist; other cells stay, with a status."""
    status = prediction_status_coarse(features)
    ready = with_vector(cells.where(all_present(features)), features)
    done = model.transform(ready).select(
        *keep, F.col("_prediction").alias("raw_predicted_PM25"),
        clip_negative(F.col("_prediction")).alias("predicted_PM25"),
        F.lit("valid").alias("prediction_status"))
    rest = cells.where(~all_present(features)).select(
        *keep, F.lit(None).cast("double").alias("raw_predicted_PM25"),
        F.lit(None).cast("double").alias("predicted_PM25"), status.alias("prediction_status"))
    return done.unionByName(rest)
