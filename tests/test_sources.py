from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from airq.operators import source_status as S, serve as SV, tiles as TL
from airq.operators.grid import make_tiles
from airq.sources import readers, sinks


def test_station_csv_variants(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "site_id,From Date,lat,lng,pm2_5,extra\nA,2025-01-01 00:00:00,19.0,72.8,115.6,x\n"
        "A,2025-01-01T05:30:00+05:30,19.0,72.8,n/a,x\nB,never,abc,72.8,3,x\n", encoding="utf-8")
    rows = readers.read_station_csv(spark, str(tmp_path / "a.csv")).orderBy("station_id", F.col("`PM2.5`").desc()).collect()
    assert rows[0]["PM2.5"] == 115.6 and str(rows[0].timestamp) == "2024-12-31 18:30:00"
    assert rows[1]["PM2.5"] is None and str(rows[1].timestamp) == "2025-01-01 00:00:00"
    assert rows[2].timestamp is None and rows[2].latitude is None


def test_latin1_semicolon(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_bytes("station_id;timestamp;latitude;longitude;PM2.5\nZürich;2025-01-01 00:00:00;47.3;8.5;9\n".encode("latin-1"))
    encoding, sep = readers.sniff_csv(spark, str(path))
    assert (encoding, sep) == ("ISO-8859-1", ";")
    row = readers.read_station_csv(spark, str(path), encoding, sep, "UTC").first()
    assert (row.station_id, row["PM2.5"]) == ("Zürich", 9.0)


def test_unresolved_columns(spark):
    with pytest.raises(ValueError, match="latitude"):
        readers.rename_resolved(spark.createDataFrame([(1,)], "station int"), readers.STATION_ALIASES)
    found, missing = readers.resolve_columns(["Site", "PM 2.5", "time", "mylat"], readers.STATION_ALIASES, {"latitude": "mylat"})
    assert found == {"station_id": "Site", "PM2.5": "PM 2.5", "timestamp": "time", "latitude": "mylat"}
    assert missing == ["longitude"]


def test_weather_names(spark):
    df = spark.createDataFrame([("2025-01-01", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 9.0)],
                               "valid_time string, lat double, long double, t2m double, rh double, u10 double, v10 double, junk double")
    assert readers.normalize_weather(df).columns == [
        "time", "latitude", "longitude", "temperature", "relative_humidity", "u_wind", "v_wind"]


def test_road_tiles(spark, tmp_path):
    for name, text in {"roads_tile_a.json": json.dumps({"tile_id": "t1", "road_segments": 5}),
                       "roads_tile_b.json": json.dumps({"tile_id": "t1", "road_segments": 9}),
                       "roads_tile_c.json": "{broken", "roads_tile_d.json": json.dumps({"road_segments": 3}),
                       "other.json": json.dumps({"tile_id": "t9", "road_segments": 1})}.items():
        (tmp_path / name).write_text(text)
    got = {r.tile_id: r.road_segments for r in readers.read_road_tiles(spark, str(tmp_path)).collect()}
    assert got == {"t1": 9}


def test_vector_and_tabular(spark, tmp_path):
    line = {"type": "Feature", "properties": {"highway": "primary"},
            "geometry": {"type": "LineString", "coordinates": [[0.0, 0.0], [2.0, 2.0]]}}
    far = {"type": "Feature", "properties": {"highway": "x"},
           "geometry": {"type": "LineString", "coordinates": [[50.0, 50.0], [52.0, 52.0]]}}
    (tmp_path / "v.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [line, far]}, indent=1))
    got = readers.ingest_vector(spark, str(tmp_path / "v.geojson"), (1.0, 1.0, 3.0, 3.0)).collect()
    assert [r.highway for r in got] == ["primary"]
    spark.createDataFrame([(1.0, 1.0), (9.0, 1.0)], "longitude double, latitude double").write.parquet(str(tmp_path / "t"))
    df = readers.ingest_tabular(spark, str(tmp_path / "t"), (0.0, 0.0, 1.0, 1.0))
    assert df.count() == 1
    assert "PushedFilters: [IsNotNull" in df._jdf.queryExecution().executedPlan().toString()


def test_sinks_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, "2025-01-01"), (2, "2025-01-02")], "v int, date string")
    sinks.write_parquet(df, str(tmp_path / "p"), ["date"], ["v"])
    sinks.write_csv_report(df, str(tmp_path / "c"))
    sinks.write_json_report(df, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "p")).where("date = '2025-01-02'").count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert {r.v for r in spark.read.json(str(tmp_path / "j")).collect()} == {1, 2}
    manifest = sinks.artifact_manifest(spark, str(tmp_path / "j"), "osm", "*.txt")
    assert all(len(r.sha256) == 64 for r in manifest.collect())
    bad = manifest.withColumn("sha256", F.lit("0" * 64))
    assert {r.status for r in sinks.validate_manifest(manifest, manifest).collect()} == {"ok"}
    assert {r.status for r in sinks.validate_manifest(manifest, bad).collect()} == {"changed"}
    zones = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 1.0)], "hotspot_id int, w double, s double, e double, n double")
    features = sinks.geojson_features(zones, F.col("w"), F.col("s"), F.col("e"), F.col("n"), ["hotspot_id"])
    sinks.write_geojson_zones(features, str(tmp_path / "g"))
    feature = json.loads(spark.read.text(str(tmp_path / "g")).first()[0])
    assert feature["geometry"]["coordinates"][0][2] == [2.0, 1.0]


def test_features_have_plain_numbers(spark):
    zones = spark.createDataFrame([(1, 12345678.25, 0.0, 69_999_500.0, -1.5, 7e7), (2, None, 0.001, 1e16, 0.1, 123456789.12345678)],
                                  "zone_id int, area double, w double, s double, e double, n double")
    features = [r.value for r in sinks.geojson_features(zones, F.col("w"), F.col("s"), F.col("e"), F.col("n"), ["zone_id", "area"]).orderBy("zone_id").collect()]
    assert features[0] == ('{"type":"Feature","properties":{"zone_id":1,"area":12345678.25},"geometry":{"type":"Polygon","coordinates":'
                           '[[[0.0,69999500.0],[-1.5,69999500.0],[-1.5,70000000.0],[0.0,70000000.0],[0.0,69999500.0]]]}}')
    second = json.loads(features[1])
    assert second["properties"] == {"zone_id": 2} and second["geometry"]["coordinates"][0][2] == [0.1, 123456789.12345678]
    assert "E" not in features[1] and "[0.001,10000000000000000.0]" in features[1]


def test_tiles_record_failures(spark):
    tiles = make_tiles(spark, (0.0, 0.0, 20.0, 10.0))

    def work(tile):
        if tile["tile_id"] == "tile_001_000":
            raise RuntimeError("boom")
        return "fine"

    got = {r.tile_id: (r.status, r.result, r.error) for r in TL.per_tile(tiles, work).collect()}
    assert got == {"tile_000_000": ("completed", "fine", None), "tile_001_000": ("failed", None, "RuntimeError: boom")}
    assert TL.limit_tiles(tiles, 1).first().tile_id == "tile_000_000"


def test_areas_and_scopes(spark):
    req = spark.createDataFrame([(1, "pune", None, None, None, None), (2, None, 77.1, 28.5, 77.2, 28.6), (3, None, None, None, None, None)],
                                "id int, region string, west double, south double, east double, north double")
    got = {r.id: r for r in S.scope_gate(S.resolve_aoi(req)).collect()}
    assert (got[1].aoi, got[1].can_predict, got[1].metric_epsg) == ("pune", False, 32643)
    assert (got[2].aoi, got[2].can_predict) == ("Custom AOI", True)
    assert (got[3].aoi, got[3].scope_status) == ("delhi", "available")
    assert S.region_table(spark).count() == 5
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 20.0, 1.0), (2, 5.0, 0.0, 1.0, 1.0)], "id int, west double, south double, east double, north double")
    assert [bool(r.box_error) for r in SV.check_boxes(boxes).collect()] == [True, True]


def test_coverage_scope_guard(spark):
    rep = spark.createDataFrame([("pm25", "AVAILABLE", "delhi")], "source string, status string, built_for_scope string")
    assert SV.coverage_for_scope(rep, "delhi").first().status == "AVAILABLE"
    assert SV.coverage_for_scope(rep, "india").first().status == "not_run"


def test_freshness_report(spark):
    files = spark.createDataFrame([("pm25", "2025-01-01 00:00:00", 10), ("pm25", "2025-01-05 00:00:00", 0), ("dem", "2024-01-01 00:00:00", 5)],
                                  "source string, m string, length bigint").withColumn("modified", F.col("m").cast("timestamp"))
    got = {r.source: (r.present, r.fresh) for r in S.freshness_report(files, F.lit("2025-01-06").cast("timestamp")).collect()}
    assert got == {"pm25": (False, False), "dem": (True, False)}
