from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from airq.operators import downscale as DS, features as FT, folds as FO, leakage as L, models as M
from airq.operators import readiness as RE, reports as RP, uncertainty as U
from airq.schemas import FEATURES, TARGET, TRAINING_SCHEMA


@pytest.fixture(scope="module")
def ready(spark):
    """2,000 rows, 40 stations, 8 countries, 60 days, all features present."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(2000):
        st = i % 40
        rows.append((f"S{st}", f"C{st % 8}", 40.0 + st, 70.0 + st, dt.date(2025, 1, 1) + dt.timedelta(days=(i // 40 + st) % 60),
                     float(50 + rng.normal(0, 5) + st), *[float(x) for x in rng.uniform(1, 9, 9)]))
    daily = spark.createDataFrame(rows, "station_id string, country string, latitude double, longitude double, date date, pm25_daily double, "
                                  "AOD double, temperature_c double, relative_humidity_pct double, wind_speed_mps double, wind_direction_deg double, "
                                  "NDVI double, elevation_m double, road_density double, night_lights double")
    return FT.build_training_table(daily).persist()


def test_schema(spark, ready):
    assert ready.schema.names == TRAINING_SCHEMA.names and len(TRAINING_SCHEMA) == 38
    assert FT.check_training_schema(ready) == []
    assert FT.empty_training_table(spark).count() == 0
    row = ready.first()
    assert row.complete_case and row.n_features_available == 11


def test_road_tiles_fill_density(spark):
    daily = spark.createDataFrame([("a", "X", 28.5, 77.1, dt.date(2025, 1, 1), 5.0)],
                                  "station_id string, country string, latitude double, longitude double, date date, pm25_daily double")
    tiles = spark.createDataFrame([("tile_025_011", 7)], "tile_id string, road_segments bigint")
    row = FT.build_training_table(daily, road_tiles=tiles).first()
    assert (row.road_density, row.road_density_available, row.AOD_available, row.complete_case) == (7.0, True, False, False)


def test_readiness(spark, ready):
    yes = RE.readiness_verdict(RE.readiness_checks(ready)).first()
    assert (yes.model_training_ready, yes.score, yes.failed_checks) == ("YES", 100.0, "")
    no_aod = ready.withColumn("AOD", F.lit(None).cast("double"))
    checks = RE.readiness_checks(no_aod)
    assert RE.readiness_verdict(checks).first().model_training_ready == "NO"
    assert not checks.where("check = 'source_aod'").first().passed
    assert "feature_sources_ready" in RE.readiness_verdict(checks).first().failed_checks
    stale = RE.readiness_verdict(RE.readiness_checks(ready, pm25_fresh=False)).first()
    assert stale.failed_checks == "data_freshness"
    few = RE.readiness_verdict(RE.readiness_checks(ready.where("station_id = 'S1'"))).first()
    assert few.model_training_ready == "NO"


def test_leakage(spark, ready):
    suite = {r.check: r.status for r in L.leakage_suite(ready).collect()}
    assert "FAIL" not in suite.values() and suite["synthetic_contamination"] == "NONE"
    L.require_clean(L.leakage_suite(ready))
    doubled = ready.unionByName(ready.limit(1))
    with pytest.raises(ValueError, match="duplicate_station_date"):
        L.require_clean(L.leakage_suite(doubled))
    tagged = ready.withColumn("city", F.lit("My_SAMPLE_city"))
    assert {r.check: r.status for r in L.leakage_suite(tagged).collect()}["synthetic_contamination"] == "PRESENT"
    inside = ready.withColumns({"latitude": F.lit(28.5), "longitude": F.lit(77.1)})
    assert L.scope_contamination(inside, "global").first()[0] == 2000
    assert L.scope_contamination(inside, "delhi").first()[0] == 0
    assert L.leaked_features(["AOD", "aqi_lag"]) == ["aqi_lag"]


def test_model_inputs(spark, ready):
    L.require_model_inputs(ready, ["AOD"], TARGET, "station_id")
    with pytest.raises(ValueError, match="missing columns"):
        L.require_model_inputs(ready, ["nope"], TARGET, "station_id")
    with pytest.raises(ValueError, match="non_finite"):
        L.require_model_inputs(ready.withColumn("AOD", F.lit(float("nan"))), ["AOD"], TARGET, "station_id")
    with pytest.raises(ValueError, match="two groups"):
        L.require_model_inputs(ready.where("station_id = 'S1'"), ["AOD"], TARGET, "station_id")


def test_valid_and_complete(spark, ready):
    t = ready.limit(50).withColumn(TARGET, F.when(F.col("station_id") == "S1", -1.0).otherwise(F.col(f"`{TARGET}`")))
    assert FT.valid_target(t).where("station_id = 'S1'").count() == 0
    no = ready.withColumn("AOD", F.lit(None).cast("double"))
    assert FT.complete_cases(no, FEATURES).count() == 0
    assert FT.complete_cases(no, FT.without_aod(FEATURES)).count() == 2000


def test_folds(spark, ready):
    few = ready.where(F.col("station_id").isin("S1", "S2", "S3"))
    assert {(r.station_id, r.fold) for r in FO.assign_folds(few, "station_id").select("station_id", "fold").distinct().collect()} == {
        ("S1", 0), ("S2", 1), ("S3", 2)}
    many = FO.assign_folds(ready, "station_id")
    sizes = [r["count"] for r in many.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 50
    splits = FO.split_rows(many.select("station_id", "date", "fold"), 5)
    assert splits.count() == 10000 and FO.split_overlap(splits, "station_id").count() == 0
    bad = splits.unionByName(splits.where("split = 'test'").withColumn("split", F.lit("train")).limit(1))
    assert FO.split_overlap(bad, "station_id").count() == 1
    dealt = FO.assign_folds(few, "station_id", "group_kfold", 2)
    assert FO.split_overlap(FO.split_rows(dealt.select("station_id", "date", "fold"), 2), "station_id").count() == 0
    assert FO.choose_strategy(40, "leave_one_group_out") == "leave_one_group_out"


def test_split_sizes_equal_written_splits(spark):
    rows = [("a", 0), ("a", 0), ("a", 1), ("b", 1), (None, 2), (None, 0), ("c", 2)]
    folded = spark.createDataFrame(rows, "g string, fold int")
    got = {(r.fold, r.split): (r.rows, r.groups, r.shared) for r in FO.split_sizes(folded, "g").collect()}
    written = [(k, "test" if f == k else "train", g) for g, f in rows for k in range(3)]
    for fold, split in {(k, s) for k, s, _ in written}:
        mine = [g for k, s, g in written if (k, s) == (fold, split)]
        both = {g for k, s, g in written if k == fold and s == "test"} & {g for k, s, g in written if k == fold and s == "train"}
        assert got.pop((fold, split)) == (len(mine), len(set(mine)), len(both))
    assert not got
    assert [(r.split, r.rows) for r in FO.split_sizes(folded.where("fold = 2"), "g").collect()] == [("test", 2)]
    assert FO.split_sizes(folded.where("fold > 5"), "g").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_folds_are_dealt_as_by_a_heap(spark, seed):
    import heapq
    import random
    rng = random.Random(seed)
    groups = [(f"g{i:03d}", rng.choice([1, 1, 1, 2, 3, 7, 40])) for i in range(60)] + [("big", 200), (None, 3)]
    rows = spark.createDataFrame([(g, i) for g, n in groups for i in range(n)], "g string, i int")
    heap, want = [(0, f) for f in range(5)], {}
    for g, n in sorted(groups, key=lambda x: (-x[1], x[0] or "")):
        size, fold = heapq.heappop(heap)
        want[g] = fold
        heapq.heappush(heap, (size + n, fold))
    got = FO.assign_folds(rows, "g", "group_kfold")
    assert got.count() == rows.count()
    assert {r.g: r.fold for r in got.select("g", "fold").distinct().collect()} == want
    alone = FO.assign_folds(rows, "g", "leave_one_group_out").select("g", "fold").distinct().collect()
    assert [r.g for r in sorted(alone, key=lambda r: r.fold)] == sorted(dict(groups), key=lambda g: g or "")


def test_fold_metrics(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 2.0, 2.0), (0, 3.0, 2.0), (1, 1.0, 1.0), (1, 2.0, 5.0)],
                               "fold int, observed_PM25 double, predicted_PM25 double").withColumn("model", F.lit("m"))
    got = {r.fold: r for r in FO.fold_metrics(df, ["fold"]).collect()}
    assert (got[0].mae, got[0].r2) == (pytest.approx(2 / 3), pytest.approx(0.0)) and got[1].r2 is None
    agg = FO.aggregate_metrics(df).first()
    assert (agg.valid_r2_folds, agg.r2_undefined_folds, agg.validated) == (1, 1, False)


def test_grouped_cv_and_prediction(spark, ready):
    feats = ["AOD", "temperature_c", "day_of_year"]
    make = {"forest": lambda: M.forest(numTrees=3, maxDepth=2), "boosted": lambda: M.boosted_trees(maxIter=2)}
    oof = M.grouped_cv(ready, feats, "country", make, strategy="leave_one_group_out")
    assert oof.groupBy("model").count().collect() and {r["count"] for r in oof.groupBy("model").count().collect()} == {2000}
    held = oof.select("fold", "country").distinct().groupBy("fold").count().collect() if "country" in oof.columns else []
    assert all(r["count"] == 1 for r in held)
    with pytest.raises(ValueError):
        M.grouped_cv(ready.where("country = 'C1'"), feats, "country", make, strategy="leave_one_group_out")
    model = M.fit(ready, M.forest(numTrees=3, maxDepth=2), feats)
    gaps = ready.withColumn("AOD", F.when(F.col("station_id") != "S1", F.col("AOD")))
    out = M.predict_cells(model, gaps, feats, ["station_id", "date"])
    counts = {r.prediction_status: r["count"] for r in out.groupBy("prediction_status").count().collect()}
    assert counts == {"valid": 1950, "missing_feature": 50}
    shares = M.feature_importance({"forest": model}, feats, spark)
    assert shares.agg(F.sum("relative_share")).first()[0] == pytest.approx(1.0)


def test_folds_fitted_together_give_what_they_give_alone(spark, ready):
    feats = ["AOD", "temperature_c", "day_of_year"]
    make = {"forest": lambda: M.forest(numTrees=3, maxDepth=2), "boosted": lambda: M.boosted_trees(maxIter=2)}
    alone, together = (
        {(r.model, r.station_id, r.date): (r.fold, r.predicted_PM25) for r in M.grouped_cv(
            ready, feats, "station_id", make, k=3, parallelism=n).collect()} for n in (1, 5))
    assert len(alone) == 2 * ready.select("station_id", "date").distinct().count()
    assert alone.keys() == together.keys()
    assert all(alone[k] == pytest.approx(together[k]) for k in alone)

    def broken():
        raise RuntimeError("no such model")
    with pytest.raises(RuntimeError, match="no such model"):
        M.grouped_cv(ready, feats, "station_id", {"forest": broken}, k=3)


def test_rows_of_equal_features_are_one_weighted_row_a_piece(spark):
    """A tree of the merged rows is the tree of all rows; vectors of few rows stay as they are."""
    a, b, i = F.col("id") % 7, F.col("id") % 5, F.col("id")
    rows = spark.range(4000).select(i.alias("at"), a.cast("double").alias("a"), b.cast("double").alias("b"), (a * b + i % 11).cast("double").alias("_label"))
    rare = spark.range(3).select((i + 9000).alias("at"), F.lit(99.0).alias("a"), F.lit(1.0).alias("b"), F.lit(60.0).alias("_label"))
    rows = rows.unionByName(rare)
    merged = M.merge_equal(rows, ["a", "b"], pieces=4).localCheckpoint()
    assert merged.count() <= 35 * 4 + 3 and merged.groupBy("a", "b").count().agg(F.max("count")).first()[0] <= 4
    assert merged.agg(F.sum("_weight"), F.sum(F.col("_weight") * F.col("_label"))).first() == pytest.approx(
        rows.agg(F.count("*"), F.sum("_label")).first())
    assert [tuple(r) for r in merged.where("a = 99").collect()] == [(99.0, 1.0, 60.0, 1.0)] * 3
    tree = {"numTrees": 1, "maxDepth": 4, "featureSubsetStrategy": "all", "bootstrap": False}
    plain = M.forest(**tree).fit(M.with_vector(rows, ["a", "b"]).select("_label", "_features"))
    mine = M.fit(rows.withColumn("y", F.col("_label")), M.forest(**tree), ["a", "b"], "y")
    for model in (M._fitted(M.forest(**tree), M.with_vector(merged, ["a", "b"])), mine):
        assert model.toDebugString.split("\n", 1)[1].count("If") == plain.toDebugString.split("\n", 1)[1].count("If")
        probe = M.with_vector(rows.select("a", "b").distinct(), ["a", "b"])
        got, want = ({(r.a, r.b): r._prediction for r in m.transform(probe).collect()} for m in (model, plain))
        assert got == pytest.approx(want)


def test_downscale_preserves_parents(spark):
    kids = spark.createDataFrame([(0, 0, 10.0, 8.0, 0.25), (0, 0, 10.0, None, 0.25), (0, 0, 10.0, 16.0, 0.5), (0, 1, None, 3.0, 0.25)],
                                 "pr int, pc int, parent_pm25 double, pm25_final double, area_km2 double")
    out = DS.apply_parent_consistency(kids, ["pr", "pc"])
    report = DS.parent_consistency_report(out.where("parent_pm25 is not null"), ["pr", "pc"]).first()
    assert report.n_parents_compared == 1 and report.max_abs_diff == pytest.approx(0.0, abs=1e-9)
    base = DS.downscale(kids.drop("pm25_final"), None)
    assert {r.prediction_status for r in base.collect()} == {"baseline_prototype", "missing_parent"}
    assert DS.fit_residual_model(kids.withColumn("residual_pm25", F.lit(1.0)), ["parent_pm25"]) is None


def test_reports_on_small_frames(spark, ready):
    t = ready.withColumn("AOD", F.when(F.col("country") != "C1", F.col("AOD")))
    assert RP.geographic_bias(t).first().feature == "AOD"
    assert RP.top_missing(RP.feature_coverage(t, FEATURES)).first().feature == "AOD"
    pairs = RP.correlation_pairs(ready.limit(60), [TARGET, "AOD", "NDVI"], ["station_id", "date"])
    assert pairs.count() == 3
    assert RP.correlation_pairs(ready.limit(1), [TARGET, "AOD"], ["station_id", "date"]).count() == 0
    stats = {(r.level, r.name): r.stations for r in RP.group_statistics(RP.spatial_group_labels(ready)).collect()}
    assert stats[("all", "all")] == 40 and stats[("country", "C1")] == 5 and stats[("region", "Unclassified")] == 40
    small = {r.method: r.status for r in RP.loso_loco_status(ready.limit(3)).collect()}
    assert set(small.values()) == {"INSUFFICIENT_DATA"}


def test_uncertainty_deferral(spark, ready):
    few = ready.limit(4).withColumn("p", F.lit(50.0))
    r = U.residual_uncertainty(few, TARGET, "p")
    assert r.first().status == "DEFERRED" and r.first().rmse_ug_m3 is None
    gaps = U.feature_gap_uncertainty(ready)
    none = spark.createDataFrame([], "distance_km double")
    score = U.uncertainty_score(r, gaps, U.distance_uncertainty(none)).first()
    assert (score.status, score.uncertainty_score, score.n_components) == ("PARTIAL", 0.0, 1)


def test_registered_models_have_all_their_rounds(spark, monkeypatch):
    from airq.plans import modelling
    made = []
    monkeypatch.setattr(modelling, "_train", lambda spark, sf_dir: None)
    monkeypatch.setattr(modelling, "rounded", lambda df, *columns, **digits: df)
    monkeypatch.setattr(modelling.FO, "aggregate_metrics", lambda oof: oof)
    monkeypatch.setattr(modelling.M, "grouped_cv", lambda df, features, group, estimators: made.append(estimators["boosted"]()))
    monkeypatch.setattr(modelling.M, "fit", lambda df, estimator, features: made.append(estimator))
    monkeypatch.setattr(modelling.M, "feature_importance", lambda *args: None)
    modelling.grouped_cross_validation(spark, "")
    modelling.feature_importance(spark, "")
    assert [m.getMaxIter() for m in made if hasattr(m, "getMaxIter")] == [200, 200]
