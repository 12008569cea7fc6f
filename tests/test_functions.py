from __future__ import annotations

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from airq.functions import aqi, geo, masks, met, status, units

GOLDEN = [(0, 0, "GOOD"), (30, 50, "GOOD"), (30.9, 51, "SATISFACTORY"), (31, 51, "SATISFACTORY"),
          (60, 100, "SATISFACTORY"), (61, 101, "MODERATELY_POLLUTED"), (90, 200, "MODERATELY_POLLUTED"),
          (91, 201, "POOR"), (120, 300, "POOR"), (121, 301, "VERY_POOR"), (250, 400, "VERY_POOR"),
          (250.1, 401, "SEVERE"), (350, 500, "SEVERE"), (400, 500, "SEVERE")]


def test_aqi_golden_values(spark):
    rows = spark.createDataFrame([(float(c),) for c, _, _ in GOLDEN], "c double")
    out = rows.withColumn("a", aqi.round_aqi(aqi.pm25_to_aqi(F.col("c")))).withColumn(
        "k", aqi.aqi_category(F.col("a"))).collect()
    assert [(r.a, r.k) for r in out] == [(a, k) for _, a, k in GOLDEN]


@pytest.mark.parametrize("c,expected", [(15, 25), (45, 74.655), (75, 148.793), (105, 248.793),
                                        (185, 350.116), (30.5, 50.155)])
def test_aqi_inside_and_gap(one, c, expected):
    assert one(aqi.pm25_to_aqi(F.lit(float(c)))) == pytest.approx(expected, abs=1e-3)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), -1.0, None])
def test_aqi_refuses(one, bad):
    value = F.lit(bad).cast("double")
    assert one(aqi.pm25_to_aqi(value), aqi.aqi_category(aqi.pm25_to_aqi(value))) == (None, None)


def test_rounding_and_schemes(one):
    assert one(*[aqi.round_aqi(F.lit(v)) for v in (0.5, 1.5, 2.5)]) == (0, 2, 2)
    assert one(aqi.round_aqi(F.lit(50.9), "floor")) == 50
    assert one(aqi.aqi_category(F.lit(125), "us_epa")) == "UNHEALTHY_SENSITIVE_GROUPS"
    assert one(aqi.aqi_category_inclusive(F.lit(501)), aqi.aqi_category_inclusive(F.lit(51))) == (
        None, "SATISFACTORY")
    assert one(aqi.aqi_scheme_for(F.lit("global")), aqi.aqi_scheme_for(F.lit("mars"))) == (
        "none", "india_cpcb")
    assert one(aqi.aqi_by_scheme(F.lit(10.0), F.lit("none"))) is None


@pytest.mark.parametrize("unit,factor", [
    ("ug/m3", 1.0), ("µg/m³", 1.0), ("μg/m³", 1.0), (" UG / M^3 ", 1.0), ("mg/m3", 1000.0),
    ("g/m3", 1e6), ("ng/m3", 0.001), ("ppm", None), ("furlong", None), (None, None),
    ("micrograms per /m3", 1.0), ("micrograms per m3", None)])
def test_units(one, unit, factor):
    assert one(units.unit_factor(F.lit(unit).cast("string"))) == factor


def test_temperature(one):
    assert one(units.kelvin_to_celsius(F.lit(300.0), F.lit("Kelvin"))) == pytest.approx(26.85)
    assert one(units.kelvin_to_celsius(F.lit(20.0), F.lit("degC"))) == 20.0
    with pytest.raises(PySparkException):
        one(units.kelvin_to_celsius(F.lit(1.0), F.lit("F")))


def test_wind(one):
    assert one(met.wind_direction_from(F.lit(0.0), F.lit(-1.0))) == 0.0
    assert one(met.wind_direction_from(F.lit(-1.0), F.lit(0.0))) == pytest.approx(90.0)
    u, v = one(met.wind_u(F.lit(5.0), F.lit(90.0)), met.wind_v(F.lit(5.0), F.lit(90.0)))
    assert (u, v) == (pytest.approx(-5.0), pytest.approx(0.0, abs=1e-12))
    assert one(met.wind_u(F.lit(None).cast("double"), F.lit(1.0))) is None


def test_calendar(one):
    f = met.temporal_features(F.lit("2024-03-01").cast("date"))
    assert one(f["month"], f["day_of_year"]) == (3.0, 61.0)
    assert one(f["sin_day_of_year"]) == pytest.approx(math.sin(2 * math.pi * 61 / 365.25))
    bad = met.temporal_features(F.lit("nope").try_cast("date"))
    assert one(*bad.values()) == (None,) * 4


def test_masks(one):
    lit = lambda v: F.lit(v)
    assert one(masks.mask_aod(lit(500.0), lit(0)), masks.mask_aod(lit(500.0), lit(1)),
               masks.mask_aod(lit(500.0), lit(4)), masks.mask_aod(lit(3001.0), lit(0))) == (
        0.5, None, 0.5, None)
    assert one(masks.mask_ndvi(lit(5000.0), lit(1)), masks.mask_ndvi(lit(-3000.0), lit(0)),
               masks.mask_ndvi(lit(5000.0), lit(3))) == (0.5, None, None)
    assert one(masks.mask_viirs(lit(2.0), lit(0)), masks.mask_viirs(lit(-999.9), lit(0)),
               masks.mask_viirs(lit(-0.5), lit(0)), masks.mask_viirs(lit(2.0), lit(1))) == (
        2.0, None, None, None)
    assert one(masks.mask_dem(lit(-32768)), masks.dem_suspicious(lit(9500.0))) == (None, True)


def test_utm_anchors(spark, one):
    pts = spark.createDataFrame([(3.0, 45.0), (77.2, 28.6), (-60.0, -33.0)], "lon double, lat double")
    pts = pts.withColumn("e", geo.utm_epsg(F.col("lon"), F.col("lat")))
    out = geo.with_lonlat(geo.with_utm(pts, "lon", "lat", F.col("e")), "x", "y", F.col("e"), "lo", "la")
    rows = out.collect()
    assert [r.e for r in rows] == [32631, 32643, 32721]
    assert (rows[0].x, rows[0].y) == (pytest.approx(500000.0), pytest.approx(4982950.40, abs=0.01))
    for r in rows:
        assert (r.lo, r.la) == (pytest.approx(r.lon, abs=1e-8), pytest.approx(r.lat, abs=1e-8))
    assert one(geo.utm_zone(F.lit(180.0)), geo.utm_zone(F.lit(-180.0))) == (60, 1)
    world = [F.lit(v) for v in (-180.0, -90.0, 180.0, 90.0)]
    assert one(geo.metric_epsg_for_bbox(*world)) is None


def test_names(one):
    assert one(geo.tile_id(F.lit(77.0), F.lit(28.0)), geo.tile_id(F.lit(180.0), F.lit(90.0))) == (
        "tile_025_011", "tile_035_017")
    assert one(geo.srtm_tile_name(F.lit(77.5), F.lit(28.5)), geo.srtm_tile_name(F.lit(-0.5), F.lit(-0.5))) == (
        "N28E077", "S01W001")
    lon, lat = geo.srtm_tile_corner(F.lit("data/S01W001.hgt"))
    assert one(lon, lat) == (-1.0, -1.0)
    assert one(geo.region_of_country(F.lit("Nepal")), geo.region_of_country(F.lit(None).cast("string"))) == (
        "South Asia", "Unclassified")


def test_scopes(one):
    box = lambda *v: [F.lit(float(x)) for x in v]
    assert one(geo.infer_scope(*box(77.1, 28.5, 77.2, 28.6)), geo.infer_scope(*box(70, 10, 80, 30)),
               geo.infer_scope(*box(-10, 0, 10, 10)), geo.infer_scope(*box(-200, 0, 10, 10))) == (
        "delhi", "india", "global", "outside_all_scopes")
    assert one(geo.scope_isolated(F.lit("india"), F.lit("delhi")),
               geo.scope_isolated(F.lit("global"), F.lit("delhi"))) == (False, True)
    area = one(geo.spherical_rectangle_km2(*box(-180, -90, 180, 90)))
    assert area == pytest.approx(5.1007e8, rel=1e-3)


def test_distance(one):
    assert one(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111.195, abs=0.01)


def test_freshness_and_confidence(one):
    as_of = F.lit("2025-01-10 00:00:00").cast("timestamp")
    f = status.freshness(F.lit("2025-01-09T00:00:00Z"), F.lit(7 * 86400), as_of)
    assert one(f["fresh"], f["age_s"], f["stale_reason"]) == (True, 86400.0, None)
    f = status.freshness(F.lit("2024-01-10T00:00:00Z"), F.lit(100), as_of)
    assert one(f["stale_reason"]) == "age_31622400s_exceeds_window_100s"
    assert one(status.freshness(F.lit("x"), F.lit(1), as_of)["stale_reason"]) == "unparseable_timestamp"
    assert one(status.freshness(F.lit(None).cast("string"), F.lit(1), as_of)["stale_reason"]) == "never_fetched"
    level = lambda s, fr, ck: status.confidence(F.lit(s), F.lit(fr), F.lit(ck))["confidence"]
    assert one(level("FAILED", True, True), level("STALE", True, True), level("PARTIAL", True, True),
               level("AVAILABLE", False, True), level("AVAILABLE", True, False),
               level("AVAILABLE", True, True)) == ("NONE", "LOW", "MEDIUM", "MEDIUM", "LOW", "HIGH")
    assert one(status.ready_for_training(F.lit("AVAILABLE"), F.lit("MEDIUM")),
               status.ready_for_training(F.lit("AVAILABLE"), F.lit("MEDIUM"), "HIGH")) == (True, False)


def test_clip_and_status(one):
    assert one(status.clip_negative(F.lit(-2.0)), status.clip_negative(F.lit(None).cast("double"))) == (0.0, None)
    s = lambda p, r, m: status.prediction_status_fine(F.lit(p).cast("double"), F.lit(r).cast("double"), m)
    assert one(s(None, 1.0, True), s(1.0, None, True), s(1.0, 1.0, True), s(1.0, None, False)) == (
        "missing_parent", "missing_feature", "downscaled_residual", "baseline_prototype")


def test_polygon(one):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    inside = lambda x, y: geo.point_in_polygon(F.lit(float(x)), F.lit(float(y)), ring)
    assert one(inside(1, 1), inside(2, 3), inside(3.5, 3), inside(0, 0), inside(2, 0), inside(5, 1)) == (
        True, False, True, False, False, False)
