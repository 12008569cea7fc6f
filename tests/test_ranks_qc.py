from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from airq.operators import qc
from airq.operators.daily import daily_mean, daily_report
from airq.operators.dedupe import keep_first, latest
from airq.operators.ranks import average_ranks, benjamini_hochberg, distinct_value_ranks, exact_quantiles


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    values = np.concatenate([np.full(4000, 7.0), rng.lognormal(3, 2, 3000).round(2), [1e12, -5.0, 7.0]])
    groups = np.where(np.arange(len(values)) % 3 == 0, "hot", "g" + (np.arange(len(values)) % 17).astype(str).astype(object))
    return values, groups


def test_quantiles_match_numpy(spark, skewed):
    values, groups = skewed
    df = spark.createDataFrame([(str(g), float(v)) for g, v in zip(groups, values)], "g string, v double")
    df = df.unionByName(spark.createDataFrame([("hot", None), (None, float("nan"))], "g string, v double"))
    got = exact_quantiles(df, "v", {"a": 0.1, "m": 0.5, "z": 0.97}).first()
    assert tuple(got) == tuple(pytest.approx(np.quantile(values, p)) for p in (0.1, 0.5, 0.97))
    per = {r.g: r.m for r in exact_quantiles(df, "v", {"m": 0.5}, by=["g"]).collect()}
    assert set(per) == set(groups)
    for g in set(groups):
        assert per[g] == pytest.approx(np.median(values[groups == g]))


def test_average_ranks(spark):
    df = spark.createDataFrame([(v,) for v in [3.0, 1.0, 3.0, 2.0, 3.0]], "v double")
    got = {r.v: r.avg_rank for r in average_ranks(df, "v").collect()}
    assert got == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_positions_across_range_partitions(spark, skewed, by):
    """Positions equal a plain count, for a hot value, a hot group and a NULL group cut into many partitions."""
    values, groups = skewed
    rows = [(None if g == "g3" else str(g), float(v)) for g, v in zip(groups, values)]
    df = spark.createDataFrame(rows, "g string, v double")
    before = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = distinct_value_ranks(df, "v", by).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    held = {}
    for g, v in rows:
        held.setdefault(g if by else "all", []).append(v)
    assert len(got) == sum(len(set(vs)) for vs in held.values())
    for r in got:
        vs = np.array(held[r.g if by else "all"])
        assert (r.n, r.below, r.total) == ((vs == r.v).sum(), (vs < r.v).sum(), len(vs))


def test_ranks_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert distinct_value_ranks(df, "v").collect() == []
    assert exact_quantiles(df, "v", {"m": 0.5}).first().m is None


def test_benjamini_hochberg(spark):
    ps = [0.01, 0.04, 0.03, 0.039, 0.6]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = {r.p: r.significant for r in benjamini_hochberg(df, "p", 0.05).collect()}
    assert got == {0.01: True, 0.04: True, 0.03: True, 0.039: True, 0.6: False}
    none = benjamini_hochberg(df.where("p > 0.5"), "p", 0.05).collect()
    assert [r.significant for r in none] == [False]


BASE = [("S1", "2025-01-01 01:00:00", 28.5, 77.1, 10.0, "ug/m3", "India"),
        ("S1", "2025-01-01 01:00:00", 28.5, 77.1, 10.0, "ug/m3", "India"),
        ("S1", "2025-01-01 02:00:00", 28.5, 77.1, 12.0, "ug/m3", "India"),
        ("S2", "2025-01-01 03:00:00", 28.6, 77.2, 11.0, "ug/m3", "India"),
        ("S2", "2025-01-01 04:00:00", 28.6, 77.2, 13.0, "ug/m3", "India"),
        ("S2", "2025-01-01 05:00:00", 28.6, 77.2, 200.0, "ug/m3", "India")]


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "ordinal int, station_id string, ts string, latitude double, longitude double, "
        "pm25_ug_m3 double, units string, country string").withColumn(
        "timestamp", F.try_to_timestamp("ts"))


def report(spark, rows):
    return qc.attrition(qc.observation_qc(frame(spark, rows), "ordinal"), qc.OBSERVATION_RULES).first()


def test_observation_qc_base(spark):
    checked = qc.observation_qc(frame(spark, BASE), "ordinal")
    r = qc.attrition(checked, qc.OBSERVATION_RULES).first()
    assert (r.input_rows, r.duplicate_rows, r.retained_rows) == (6, 1, 5)
    flagged = qc.mad_outlier_flag(qc.survivors(checked), "pm25_ug_m3")
    assert [x.pm25_ug_m3 for x in flagged.where("outlier_flag").collect()] == [200.0]
    summary = qc.observation_summary(qc.survivors(checked)).first()
    assert (summary.station_count, summary.country_count) == (2, 1)


@pytest.mark.parametrize("change,rule", [
    ({3: 91.0}, "invalid_coordinates"), ({2: "not-a-date"}, "invalid_timestamps"),
    ({5: None}, "missing_pm25"), ({6: ""}, "invalid_units"), ({5: -5.0}, "negative_pm25"),
    ({5: 5000.0}, "above_max_pm25"), ({3: None}, "invalid_coordinates")])
def test_each_rule(spark, change, rule):
    row = [None, "S9", "2025-01-02 00:00:00", 28.5, 77.1, 20.0, "ug/m3", "India"]
    for i, v in change.items():
        row[i] = v
    r = report(spark, BASE + [tuple(row[1:])])
    assert r[rule] == 1 and r.retained_rows == 5 and r.input_rows == 7


def test_attrition_accounts_for_every_row(spark):
    rows = BASE + [("S3", "x", 91.0, 77.0, None, None, "India")] * 4
    r = report(spark, rows)
    assert r.input_rows == r.duplicate_rows + r.retained_rows + sum(r[n] for n in qc.OBSERVATION_RULES)


def test_zero_mad_flags_nothing(spark):
    df = spark.createDataFrame([(5.0,)] * 9 + [(50.0,)], "v double")
    assert qc.mad_outlier_flag(df, "v").where("outlier_flag").count() == 0


def test_station_qc_order(spark):
    df = frame(spark, BASE + [("S4", "2025-01-01 00:00:00", 95.0, 77.0, -3.0, "ug/m3", "India"),
                              ("S5", "2025-01-01 00:00:00", 10.0, 77.0, 3.0, "ug/m3", "India"),
                              (None, "2025-01-01 00:00:00", 28.5, 77.0, 3.0, "ug/m3", "India"),
                              ("S6", "2025-01-01 00:00:00", 28.5, 77.0, float("inf"), "ug/m3", "India")]
               ).withColumnRenamed("pm25_ug_m3", "PM2.5")
    r = qc.attrition(qc.station_qc(df, "ordinal", (77.0, 28.0, 78.0, 29.0)), qc.STATION_RULES).first()
    assert (r.invalid_coordinates, r.impossible_coordinates, r.missing_station_ids,
            r.non_finite_values, r.negative_pm25, r.retained_rows) == (1, 1, 1, 1, 0, 5)


def test_keep_first_and_latest(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, None, "z"), (5, None, "w")], "o int, k string, v string")
    got = {r.k: (r.v, r.n) for r in keep_first(df, ["k"], "o", count_as="n").collect()}
    assert got == {"a": ("y", 2), None: ("z", 2)}
    assert {r.k: r.v for r in latest(df, ["k"], "o", ["v"]).collect()} == {"a": "x", None: "w"}


def test_daily_minimum(spark):
    df = frame(spark, BASE).withColumn("source", F.lit("s"))
    out = {r.station_id: (r.pm25_daily, r.observation_count) for r in daily_mean(df, min_observations=3).collect()}
    assert out == {"S1": (pytest.approx(32 / 3), 3), "S2": (pytest.approx(224 / 3), 3)}
    r = daily_report(df, min_observations=4).first()
    assert (r.station_days_skipped, r.station_days_retained) == (2, 0)
