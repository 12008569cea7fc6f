"""Geodesics against published lengths, joins with polygons and rectangles against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from airq.functions.geo import point_in_polygon
from airq.functions.geodesic import geodesic_km
from airq.operators import pairs, regions as R
from airq.operators.serve import cells_in_boxes
from airq.plans.geometry import _HOLE, _OUTLINE, geodesic_distances, points_in_regions, tiles_of_areas

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_published_geodesics(spark):
    want = [((40.6, -73.8, 51.6, -0.5), 5551.759400), ((-30.0, 0.0, 29.9, 179.8), 19989.832828), ((0.0, 0.0, 0.5, 179.5), 19936.288579),
            ((0.0, 0.0, 0.5, 179.7), 19944.127421), ((36.530042355041, 0.0, -48.164270779097769, 5.762344694676510), 9398.502043),
            ((90.0, 0.0, -90.0, 0.0), 20003.931459), ((0.0, 0.0, 0.0, 90.0), 10018.754171), ((0.0, 0.0, 0.0, 180.0), 20003.931459),
            ((10.0, 20.0, 10.0, 380.0), 0.0), ((0.0, 0.0, 0.0, 179.0), 19926.188852), ((89.0, 10.0, 89.0, -170.0), 223.387730)]
    df = spark.createDataFrame([w[0] for w in want], "a double, b double, c double, d double")
    ways = [("a", "b", "c", "d"), ("c", "d", "a", "b")]
    got = df.select(*[F.array(*[geodesic_km(*map(F.col, w)) for w in ways]).alias("k")]).collect()
    for r, (pair, km) in zip(got, want):
        assert r.k == pytest.approx([km, km], abs=2e-6), pair
    missing = spark.createDataFrame([(None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    assert missing.select(geodesic_km(*map(F.col, "abcd")).alias("k")).first().k is None


def test_points_in_polygons(spark):
    """Strictly inside by the even-odd rule, as the operator for one ring says; holes, shared borders, odd rows."""
    draw = random.Random(1)
    ring = lambda *p: [(float(x), float(y)) for x, y in p]
    shapes = {
        "square": [ring((0, 0), (4, 0), (4, 4), (0, 4))], "holed": [ring((0, 0), (8, 0), (8, 8), (0, 8)), ring((2, 2), (2, 6), (6, 6), (6, 2))],
        "beside": [ring((4, 0), (8, 0), (8, 4), (4, 4), (4, 0))], "huge": [ring((-100, -90), (100, -80), (90, 100), (-120, 80))],
        "sliver": [ring((1, 1), (1.01, 1), (1, 1.01))], "two": [ring((10, 10), (11, 10), (10, 11)), ring((20, 20), (22, 20), (21, 23))]}
    points = [(i, draw.uniform(-2, 12), draw.uniform(-2, 12)) for i in range(300)] + [(1000 + 10 * x + y, float(x), float(y)) for x in range(10) for y in range(10)]
    points += [(2000, 1.001, 1.001), (2001, 21.0, 21.0), (2002, None, 1.0), (None, 1.0, 1.0), (2003, 21.0, 23.0)]
    p = spark.createDataFrame(points, "id int, x double, y double")
    polygons = spark.createDataFrame([*shapes.items(), ("none", None), ("flat", [ring((0, 0), (1, 1))]), (None, shapes["square"])],
                                     "name string, rings array<array<struct<x:double,y:double>>>")
    got = {(r.id, r.name) for r in R.points_in_polygons(p, "id", "x", "y", polygons, "name", "rings", base=0.5).collect()}
    want = set()
    for name, rings in shapes.items():
        flags = [point_in_polygon(F.col("x"), F.col("y"), r).alias(f"r{i}") for i, r in enumerate(rings)]
        for r in p.where("id is not null and x is not null").select("id", *flags).collect():
            if sum(r[1:]) % 2:
                want.add((r.id, name))
    # The even-odd rule of one ring says outside on its own border, so points on the border of a hole are set apart.
    on_hole = {(1000 + 10 * x + y, "holed") for x in range(2, 7) for y in range(2, 7) if x in (2, 6) or y in (2, 6)}
    assert got - on_hole == want - on_hole and not got & on_hole


@pytest.mark.parametrize("points_a_cell", [1, 256])
def test_points_in_fine_cells_of_polygons(spark, monkeypatch, points_a_cell):
    """Points on corners, edges and cell borders of polygons in cells of all sizes; repeated points and polygons."""
    monkeypatch.setattr(R, "POINTS", points_a_cell)
    star = lambda x, y, r: [[(x + r * a, y + r * b) for a, b in corners] for corners in (_OUTLINE, _HOLE)]
    shapes = [(f"s{r}", star(2.0, 1.0, r)) for r in (0.5, 2.0, 8.0)] + [("turned", [[(0.3, -5.1), (7.7, 0.2), (2.9, 6.4), (-6.1, 3.3)]]), ("bow", [[(-4.0, -4.0), (4.0, 4.0), (4.0, -4.0), (-4.0, 4.0)]])]
    twice = ("twice", star(0.0, 0.0, 4.0))
    polygons = spark.createDataFrame([*shapes, twice, twice], "name string, rings array<array<struct<x:double,y:double>>>")
    at = [(i * 100 + j, -7.0 + i / 4.0, -7.0 + j / 4.0) for i in range(70) for j in range(64)]
    points = spark.createDataFrame([*at, (-1, 2.0, 0.9), (-1, 2.0, 0.9), (-2, float("nan"), 1.0), (-3, None, 1.0), (None, 1.0, 1.0)], "id int, x double, y double")
    got = sorted(map(tuple, R.points_in_polygons(points, "id", "x", "y", polygons, "name", "rings").collect()))

    def inside(x, y, rings):
        crossings = 0
        for (x1, y1), (x2, y2) in ((a, b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])):
            turn = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
            if turn == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            crossings += ((y1 > y) != (y2 > y)) and (turn < 0 if y2 > y1 else turn > 0)
        return crossings % 2 == 1

    assert got == sorted((i, name) for i, x, y in at for name, rings in shapes if inside(x, y, rings))


def test_most_points_meet_a_polygon_without_its_edges(spark):
    """A polygon that holds many points is laid into cells so fine that few of them meet an edge."""
    square = [[(0.5, 0.5), (63.5, 0.5), (63.5, 63.5), (0.5, 63.5)]]
    edges = R.polygon_edges(spark.createDataFrame([("a", square)], "name string, rings array<array<struct<x:double,y:double>>>"), "name", "rings")
    points = spark.range(300_000).select(F.col("id").alias("point"), (F.col("id") % 640 / 10.0).alias("x"), (F.floor(F.col("id") / 640) / 7.0).alias("y"))
    cover = R.polygon_cover(edges, points, 1.0)
    assert cover.select("level").distinct().collect()[0].level == 1
    met = R._at_levels(points, cover, 1.0).join(cover, R.CELL).agg(F.avg((F.col("n") == 0).cast("double")).alias("plain"), F.max("n").alias("most")).first()
    assert met.plain > 0.8 and met.most <= 3


def test_boxes_intersecting(spark):
    draw = random.Random(2)

    def boxes(n, seed):
        out = []
        for i in range(n):
            w, s, size = draw.uniform(-180, 170), draw.uniform(-80, 70), 2.0 ** draw.uniform(-6, 6)
            out.append((seed + i, w, s, w + size, s + size * draw.uniform(0.1, 1)))
        return out

    fixed = [(-1, 0.0, 0.0, 1.0, 1.0), (-2, 1.0, 0.0, 2.0, 1.0), (-3, 0.0, 1.0, 1.0, 2.0), (-4, -180.0, -90.0, 180.0, 90.0), (-5, 0.5, 0.5, 0.5, 3.0), (-6, None, 0.0, 1.0, 1.0)]
    a, b = boxes(120, 0) + fixed, boxes(150, 1000) + fixed
    schema = "{} int, west double, south double, east double, north double"
    got = R.boxes_intersecting(spark.createDataFrame([*a, (None, 0.0, 0.0, 9.0, 9.0)], schema.format("tile")), "tile", spark.createDataFrame(b, schema.format("area")), "area").collect()
    whole = lambda x: None not in x and x[1] < x[3] and x[2] < x[4]
    want = sorted((x[0], y[0]) for x in a for y in b if whole(x) and whole(y) and x[1] < y[3] and y[1] < x[3] and x[2] < y[4] and y[2] < x[4])
    assert sorted((r.tile, r.area) for r in got) == want
    nothing = R.boxes_intersecting(spark.createDataFrame([], schema.format("tile")), "tile", spark.createDataFrame(b, schema.format("area")), "area")
    assert nothing.count() == 0


def _crowded(monkeypatch):
    """Every key counts as crowded, however small the tables are."""
    monkeypatch.setattr(pairs, "SIDE", 3)
    monkeypatch.setattr(pairs, "PAIRS", 1)


def test_legs_are_dealt_by_rows(spark):
    assert "REPARTITION_BY_NUM" in physical(geodesic_distances(spark, SF))


def test_crowded_keys_are_cut(spark, monkeypatch):
    _crowded(monkeypatch)
    left = spark.createDataFrame([(k % 3, i) for i, k in enumerate([*[0] * 30, *range(9), 0, 0])], "k int, l int")
    right = spark.createDataFrame([(k % 3, i % 20) for i, k in enumerate([*[0] * 40, 1, 2, 2])], "k int, r int")
    got = pairs.join_by_pairs(left, right, ["k"], whole="r")
    assert sorted(map(tuple, got.select("k", "l", "r").collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    assert got.where("k = 0").select(*pairs.PIECE).distinct().count() > 20
    assert got.groupBy("k", "l", "r").agg(F.countDistinct(*pairs.PIECE).alias("n")).where("n > 1").count() == 0


def test_pieces_grow_with_the_pairs(spark, monkeypatch):
    """Rows are repeated for as many pieces as there are tasks, however many pairs there are; no pair is lost or comes twice."""
    _crowded(monkeypatch)
    monkeypatch.setattr(pairs, "TASKS", 4)
    left, right = spark.range(300).select(F.lit(1).alias("k"), F.col("id").alias("l")), spark.range(200).select(F.lit(1).alias("k"), F.col("id").alias("r"))
    got = pairs.join_by_pairs(left, right, ["k"])
    assert got.count() == got.distinct().count() == 60_000 and got.select("l", "r").distinct().count() == 60_000
    assert 2 <= got.select(*pairs.PIECE).distinct().count() <= 9


def test_pairs_with_polygons_are_not_shuffled(spark, monkeypatch):
    _crowded(monkeypatch)
    square = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]
    polygons = spark.createDataFrame([("a", square), ("b", square)], "name string, rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(i, i / 10.0, 2.0) for i in range(60)], "id int, x double, y double")
    out = R.points_in_polygons(points, "id", "x", "y", polygons, "name", "rings")
    assert sorted(map(tuple, out.collect())) == [(i, n) for i in range(1, 40) for n in "ab"]
    above = physical(out).split("Join", 1)[0]
    assert "HashAggregate" in above and "Exchange" not in above


def test_boxes_and_cells_of_crowded_keys(spark, monkeypatch):
    _crowded(monkeypatch)
    boxes = spark.createDataFrame([(i, 0.0, 0.0, 1.0 + i % 3, 1.0) for i in range(20)], "id int, west double, south double, east double, north double")
    tiles = boxes.withColumnRenamed("id", "tile")
    assert R.boxes_intersecting(tiles, "tile", boxes, "id").distinct().count() == R.boxes_intersecting(tiles, "tile", boxes, "id").count() == 400
    assert "REPARTITION_BY_NUM" in physical(R.boxes_intersecting(tiles, "tile", boxes, "id"))
    cells = spark.createDataFrame([(i / 10.0 + 1e-9, 0.5, float(i) + 0.123456) for i in range(30)], "longitude double, latitude double, v double")
    out = cells_in_boxes(boxes, cells, "id", "v", gated=False)
    got = sorted((r.id, r.longitude, r.v) for r in out.collect())
    assert got == sorted((b, round(i / 10.0, 6), round(i + 0.123456, 2)) for b in range(20) for i in range(30) if i / 10.0 + 1e-9 <= 1.0 + b % 3)
    # A cell is rounded before it meets boxes.
    assert "round(" not in physical(out).lower()


@pytest.mark.parametrize("query", [points_in_regions, tiles_of_areas])
def test_no_pairs_of_all_with_all(spark, query):
    plan = plan_of(query(spark, SF))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
