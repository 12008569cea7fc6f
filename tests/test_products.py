"""Stored layers, gated publishing and station files of mixed dialects."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from airq.schemas import TARGET
from airq.sources import layer_store as LS, publish as P
from airq.sources.dialects import file_dialects, read_mixed_station_csv


def files_read(df) -> int:
    """Files of the scan that has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    scan = leaves.head()
    return scan.metrics().apply("numFiles").value()


@pytest.fixture(scope="module")
def layers(spark, tmp_path_factory):
    rows = [(layer, dt.date(2020 + y, 1 + m * 5, 3), r, c, float(r + c)) for layer in ("a", "b") for y in range(3) for m in range(2) for r in range(0, 64, 4) for c in range(3)]
    path = str(tmp_path_factory.mktemp("layers") / "store")
    LS.write_layers(spark.createDataFrame(rows, "layer string, obs_date date, row bigint, col bigint, value double"), path, tile_rows=16)
    return path, rows


def test_window_reads_its_folders_only(spark, layers):
    path, rows = layers
    assert sum(len([f for f in files if f.endswith(".parquet")]) for _, _, files in os.walk(path)) == 2 * 3 * 4
    out = LS.read_window(spark, path, ["b"], "2020-06-01", "2021-03-31", (10, 20), 16)
    assert files_read(out) == 1 * 2 * 2
    want = [r for r in rows if r[0] == "b" and dt.date(2020, 6, 1) <= r[1] <= dt.date(2021, 3, 31) and 10 <= r[2] <= 20]
    assert sorted((r.layer, r.obs_date, r["row"], r.col, r.value) for r in out.collect()) == want


def test_windows_of_a_table(spark, layers):
    path, rows = layers
    windows = [(1, "a", dt.date(2020, 1, 1), dt.date(2022, 12, 31), 0, 5), (2, "b", dt.date(2021, 6, 3), dt.date(2021, 6, 3), 15, 17), (3, "a", None, None, 0, 9),
               (4, "b", dt.date(2022, 1, 1), dt.date(2021, 1, 1), 0, 9)]
    table = spark.createDataFrame(windows, "window_id int, layer string, first date, last date, row_from bigint, row_to bigint")
    out = LS.read_windows(spark.read.parquet(path), table, 16)
    got = sorted((r.window_id, r.layer, r.obs_date, r["row"], r.col) for r in out.collect())
    assert got == sorted((w[0], *r[:4]) for w in windows[:2] for r in rows if r[0] == w[1] and w[2] <= r[1] <= w[3] and w[4] <= r[2] <= w[5])


def test_folders_do_not_grow_with_the_rows(spark, tmp_path):
    """Far tiles share folders; windows across their ends and below row 0 hold what they should."""
    rows = [("a", dt.date(2020, 1, 1 + r % 3), r, r % 5, float(r)) for r in [*range(-150, 0), *range(1200)]]
    path = str(tmp_path / "store")
    LS.write_layers(spark.createDataFrame(rows, "layer string, obs_date date, row bigint, col bigint, value double"), path, tile_rows=1)
    assert len(os.listdir(f"{path}/layer=a/year=2020")) < 32 + 6 * 16 + 32 + 3 * 16
    ends = [(-150, -140), (-3, 3), (30, 34), (63, 65), (511, 530), (1023, 1199), (1199, 5000), (40, 39)]
    for a, b in ends:
        out = LS.read_window(spark, path, ["a"], "2020-01-01", "2020-01-02", (a, b), 1)
        assert sorted(r["row"] for r in out.collect()) == [r for r in range(-150, 1200) if a <= r <= b and r % 3 < 2]
    table = spark.createDataFrame([(i, "a", dt.date(2020, 1, 1), dt.date(2020, 1, 3), a, b) for i, (a, b) in enumerate(ends)],
                                  "window_id int, layer string, first date, last date, row_from bigint, row_to bigint")
    got = sorted((r.window_id, r["row"]) for r in LS.read_windows(spark.read.parquet(path), table, 1).collect())
    assert got == [(i, r) for i, (a, b) in enumerate(ends) for r in range(a, min(b, 1199) + 1)]
    assert all(LS.folder_of(t) <= LS.folder_of(t + 1) for t in range(-3000, 3000))


def test_pixels_without_a_place_are_refused(spark, tmp_path):
    bad = spark.createDataFrame([("a", None, 1, 1, 1.0)], "layer string, obs_date date, row bigint, col bigint, value double")
    with pytest.raises(Exception, match="a pixel without obs_date"):
        LS.write_layers(bad, str(tmp_path / "bad"))


def test_nothing_of_a_refused_product_is_visible(spark, tmp_path):
    folder = str(tmp_path / "products")
    good = spark.createDataFrame([("S1", dt.date(2024, 1, d), 5.0, 1.0) for d in (1, 2)], f"station_id string, date date, `{TARGET}` double, AOD double")
    gates = P.model_input_gates(["AOD"])
    checks = {"duplicates": P.unique_key_check(["station_id", "date"])}
    assert P.publish(good, "t", folder, gates, checks)
    before = P.read_product(spark, folder, "t").collect()
    for bad in (good.withColumn("AOD", F.lit(float("nan"))), good.unionByName(good), good.where("false"), good.drop("AOD")):
        assert not P.publish(bad, "t", folder, gates if "AOD" in bad.columns else {}, checks, ["AOD"])
    assert P.read_product(spark, folder, "t").collect() == before and len(os.listdir(f"{folder}/t")) == 1
    better = good.withColumn("AOD", F.lit(2.0))
    assert P.publish(better, "t", folder, gates, checks) and {r.AOD for r in P.read_product(spark, folder, "t").collect()} == {2.0}
    rows = P.manifest(spark, folder).orderBy("version").collect()
    assert [r.status for r in rows] == ["ACCEPTED", "REFUSED", "REFUSED", "REFUSED", "REFUSED", "ACCEPTED"]
    assert [r.failed for r in rows[1:5]] == [{"non_finite_features": 2}, {"duplicates": 2}, {"no rows": 1}, {"missing column AOD": 1}]
    with pytest.raises(ValueError, match="no version"):
        P.read_product(spark, folder, "other")


def test_mixed_dialects(spark, tmp_path):
    files = {"a.csv": "station_id,timestamp,latitude,longitude,PM2.5\nS1,2024-01-01 05:30:00,28.5,77.1,10.5\n".encode(),
             "b.csv": "﻿site_id;From Date;lat;lng;pm2_5\nS2;2024-01-01 05:30:00;28.5;77.1;n/a\nS3;x;;77.1;2\n".encode(),
             "c.csv": "id\ttime\tlat\tlon\tpm25\tplace\nS4\t2024-01-01T00:00:00Z\t28.5\t77.1\t3\tZürich, \"See\"\n".encode("iso-8859-1"), "d.csv": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    kinds = {r.file.rsplit("/", 1)[1]: (r.encoding, r.sep) for r in file_dialects(spark, str(tmp_path)).collect()}
    assert kinds == {"a.csv": ("UTF-8", ","), "b.csv": ("UTF-8", ";"), "c.csv": ("ISO-8859-1", "\t")}
    got = {r.station_id: r for r in read_mixed_station_csv(spark, str(tmp_path)).collect()}
    assert {k: r["PM2.5"] for k, r in got.items()} == {"S1": 10.5, "S2": None, "S3": 2.0, "S4": 3.0}
    assert got["S1"].timestamp == got["S4"].timestamp and got["S3"].timestamp is None and got["S3"].latitude is None
    assert got["S4"].place == 'Zürich, "See"' and got["S4"].file == "c.csv" and got["S1"].place is None
