from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from airq.operators import autocorr as A, grid as G, nearest as N, raster as R, roads as RD, zones as Z
from airq.operators.grid import Grid
from airq.operators.ordering import numbered
from airq.operators.scattered import scattered_hotspots


def cells(spark, coords):
    return spark.createDataFrame([tuple(c) for c in coords], "row bigint, col bigint")


def zones_of(spark, coords, width=16):
    labelled = Z.label_zones(cells(spark, coords), width)
    return sorted(r.n_cells for r in Z.hotspot_zones(labelled, 0.25).collect())


def test_zone_shapes(spark):
    assert zones_of(spark, [(r, c) for r in range(2) for c in range(3)]) == [6]
    assert zones_of(spark, [(0, 0), (0, 1), (1, 2)], 3) == [1, 2]
    assert zones_of(spark, [(0, 0), (1, 1)]) == [1, 1]
    u_shape = [(r, 0) for r in range(5)] + [(r, 4) for r in range(5)] + [(4, c) for c in range(1, 4)]
    assert zones_of(spark, u_shape) == [13]
    assert Z.hotspot_zones(Z.label_zones(cells(spark, [(0, 0)]).where("row > 5"), 8), 0.25).count() == 0


def flood(points):
    points, sizes = set(points), []
    while points:
        stack, n = [points.pop()], 0
        while stack:
            r, c = stack.pop()
            n += 1
            for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if p in points:
                    points.remove(p)
                    stack.append(p)
        sizes.append(n)
    return sorted(sizes)


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_random_and_spiral_zones(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rng = np.random.default_rng(5)
        pts = [(int(r), int(c)) for r, c in zip(*np.where(rng.random((24, 24)) < 0.58))]
        assert zones_of(spark, pts, 24) == flood(pts)
        spiral, r, c, dr, dc, seen = [], 0, 0, 0, 1, set()
        for steps in [16, 16, 16, 14, 14, 12, 12, 10, 10, 8, 8, 6, 6, 4, 4]:
            for _ in range(steps):
                if (r, c) not in seen:
                    spiral.append((r, c))
                    seen.add((r, c))
                r, c = r + dr, c + dc
            dr, dc = dc, -dr
        assert zones_of(spark, spiral, 24) == flood(spiral)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_long_column_and_equal_zones_of_two_days(spark):
    """A column of 1,500 single cells shrinks by a factor a round; groups do not mix, a NULL-free name is the first cell."""
    column = spark.range(1500).select(F.col("id").alias("row"), F.lit(3).cast("bigint").alias("col"))
    named = Z.label_zones(column, 8, max_rounds=12)
    assert [tuple(r) for r in named.groupBy("zone").count().collect()] == [(3, 1500)]
    with pytest.raises(RuntimeError):
        Z.label_zones(column, 8, max_rounds=1)
    days = column.where("row < 40").withColumn("day", F.explode(F.array(F.lit(1), F.lit(2)))).where("day = 1 or row <> 20")
    got = Z.hotspot_zones(Z.label_zones(days, 8, by=["day"]), 0.25, by=["day"])
    assert {(r.day, r.hotspot_id, r.n_cells) for r in got.collect()} == {(1, 1, 40), (2, 1, 20), (2, 2, 19)}


def test_zone_numbers_follow_scan_order(spark):
    labelled = Z.label_zones(cells(spark, [(5, 0), (0, 9), (0, 2)]), 16)
    out = Z.hotspot_zones(labelled, 0.25).orderBy("hotspot_id").collect()
    assert [(r.hotspot_id, r.min_row, r.min_col, r.area_km2) for r in out] == [
        (1, 0, 2, 0.25), (2, 0, 9, 0.25), (3, 5, 0, 0.25)]


@pytest.mark.parametrize("k", [1, 4])
def test_k_nearest_brute_force(spark, k):
    rng = np.random.default_rng(11)
    sites = np.vstack([rng.normal(0, 0.02, (60, 2)), rng.uniform(-3, 3, (25, 2)), np.full((30, 2), 0.5)])
    pts = np.vstack([rng.uniform(-4, 4, (80, 2)), rng.normal(0, 0.01, (20, 2)), [[30.0, -20.0]]])
    s = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(sites)], "sid int, x double, y double")
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "pid int, x double, y double")
    got = {}
    for r in N.k_nearest(p, s, ["x", "y"], k, "pid", "sid", 0.05).collect():
        got.setdefault(r.pid, []).append((r["rank"], r.sid))
    for i, point in enumerate(pts):
        d = np.hypot(*(sites - point).T)
        want = sorted(range(len(sites)), key=lambda j: (d[j], j))[:k]
        assert [sid for _, sid in sorted(got[i])] == want


def test_k_nearest_with_few_sites(spark):
    s = spark.createDataFrame([("a", 0.0, 0.0), ("b", 5.0, 5.0)], "id string, x double, y double")
    points = s.withColumnRenamed("id", "pid")
    assert N.k_nearest(points, s, ["x", "y"], 8, "pid", "id", 0.1).count() == 4
    others = N.k_nearest(s, s, ["x", "y"], 8, "id", "id", 0.1, exclude_same_id=True)
    assert others.count() == 2


def test_k_nearest_far_away_and_in_a_dense_place(spark):
    far = spark.createDataFrame([("s", 120.0, 1.0)], "sid string, x double, y double")
    one = spark.createDataFrame([("p", 0.0, 0.0)], "pid string, x double, y double")
    assert N.k_nearest(one, far, ["x", "y"], 1, "pid", "sid", 0.02).count() == 1
    rng = np.random.default_rng(5)
    dense = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 0.01, (1500, 2)))]
    s = spark.createDataFrame(dense, "sid int, x double, y double")
    p = spark.createDataFrame([(i, x + 1e-5, y) for i, x, y in dense], "pid int, x double, y double")
    base, levels = N._levels(p, s, ["x", "y"], 0.02, 1)
    assert base < 0.001 and base * 2 ** (levels + 1) >= 0.01
    got = {r.pid: r.sid for r in N.k_nearest(p, s, ["x", "y"], 1, "pid", "sid", 0.02).collect()}
    xy = np.array([d[1:] for d in dense])
    assert got == {i: int(np.argmin(np.hypot(*(xy - (x + 1e-5, y)).T))) for i, x, y in dense}


def test_nearest_station_across_the_date_line(spark):
    c = spark.createDataFrame([("c1", 179.9, 10.0), ("c2", 0.0, 89.9)], "grid_id string, longitude double, latitude double")
    s = spark.createDataFrame([("s1", -179.9, 10.0), ("s2", 170.0, 10.0), ("s3", 180.0, 88.0)],
                              "station_id string, longitude double, latitude double")
    got = {r.grid_id: (r.station_id, r.distance_km) for r in N.nearest_station(c, s, "grid_id", "station_id").collect()}
    assert got["c1"] == ("s1", pytest.approx(21.9, abs=0.1))
    assert got["c2"][0] == "s3"


def test_idw_cases(spark):
    s = spark.createDataFrame([("a", 0.0, 0.0, 10.0), ("b", 0.3, 0.0, 40.0)],
                              "station_id string, longitude double, latitude double, v double")
    c = spark.createDataFrame([("on", 0.0, 0.0), ("mid", 0.1, 0.0), ("far", 50.0, 0.0)],
                              "grid_id string, longitude double, latitude double")
    got = {r.grid_id: (r.idw, r.idw_method) for r in N.idw(c, s, "grid_id", "v").collect()}
    w1, w2 = 1 / 0.01, 1 / 0.04
    assert got["on"] == (10.0, "station") and got["far"] == (40.0, "nearest")
    assert got["mid"] == (pytest.approx((10 * w1 + 40 * w2) / (w1 + w2), rel=1e-6), "weighted")


def test_grid_and_point_join(spark):
    grid = Grid(77.0, 28.4, 0.2, 0.2, 1, 2, 77.4, 28.6)
    pts = spark.createDataFrame([(77.1, 28.5), (77.3, 28.5), (179.0, 89.0)], "x double, y double")
    ids = [r.grid_id for r in G.assign_cell(pts, grid, "x", "y", outside="").collect()]
    assert ids == ["000_000", "001_000", ""]
    covering = Grid.covering((0.0, 0.0, 2500.0, 1500.0), 1000.0)
    made = G.make_grid(spark, covering)
    assert made.count() == 6 and made.agg(F.sum("area_km2")).first()[0] == pytest.approx(3.75)
    dividing = Grid.dividing((0.0, 0.0, 2400.0, 1600.0), 1000.0, "t")
    assert (dividing.rows, dividing.cols, dividing.dx) == (2, 2, 1200.0)
    assert G.make_tiles(spark, (-180.0, -90.0, 180.0, 90.0)).count() == 648


def test_bilinear_and_gaps(spark):
    grid = Grid(0.0, 0.0, 1.0, 1.0, 3, 3, 2.0, 2.0)
    nodes = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(3) for c in range(3) if (r, c) != (2, 2)],
                                  "row bigint, col bigint, v double")
    pts = spark.createDataFrame([("a", 0.5, 0.5), ("b", 1.5, 1.5), ("c", 2.5, 0.0), ("d", 2.0, 0.5)], "id string, x double, y double")
    got = {r.id: r.o for r in R.interpolate_bilinear(pts, nodes, grid, "x", "y", "v", "o").collect()}
    assert got == {"a": 5.5, "b": None, "c": None, "d": 7.0}


def test_road_pieces(spark):
    grid = Grid.covering((0.0, 0.0, 2500.0, 2000.0), 1000.0)
    rows = [(1, 100.0, 100.0, 900.0, 100.0), (2, 500.0, 500.0, 1500.0, 500.0), (3, 0.0, 0.0, 2000.0, 2000.0),
            (4, 1000.0, 100.0, 1000.0, 900.0), (5, 2000.0, 500.0, 3000.0, 500.0), (6, -500.0, -500.0, -100.0, -100.0),
            (7, 1500.0, 1900.0, 500.0, 100.0)]
    seg = spark.createDataFrame(rows, "id int, x1 double, y1 double, x2 double, y2 double")
    got = {}
    for r in RD.cut_segments(seg, grid, "id").collect():
        got.setdefault(r.id, {})[(r["row"], r["col"])] = r.length_m
    assert got[1] == {(0, 0): pytest.approx(800)}
    assert got[2] == {(0, 0): pytest.approx(500), (0, 1): pytest.approx(500)}
    assert got[3] == {(0, 0): pytest.approx(1000 * math.sqrt(2)), (1, 1): pytest.approx(1000 * math.sqrt(2))}
    assert got[4] == {(0, 1): pytest.approx(800)}
    assert got[5] == {(0, 2): pytest.approx(500)}
    assert 6 not in got
    assert sum(got[7].values()) == pytest.approx(math.hypot(1000, 1800))


def test_road_checks(spark):
    schema = "road_id int, highway string, coords array<struct<x:double,y:double>>"
    rows = [(1, "primary", [(0.0, 0.0), (1.0, 1.0)]), (2, None, [(0.0, 0.0), (1.0, 1.0)]), (3, "primary", None),
            (4, "primary", []), (5, "track", [(0.0, 0.0)]), (6, "primary", [(0.0, float("nan")), (1.0, 1.0)])]
    df = spark.createDataFrame(rows, schema)
    r = RD.road_attrition(RD.check_roads(df)).first()
    assert tuple(r) == (6, 1, 1, 1, 2, 1)
    kept, dropped = RD.filter_highway(df, [])
    assert kept.count() == 6 and dropped.first()[0] == 0
    kept, dropped = RD.filter_highway(df, ["primary"])
    assert (kept.count(), dropped.first()[0]) == (4, 2)


def block_field(spark, planted=True):
    rng = np.random.default_rng(0)
    v = rng.normal(50, 1, (12, 12))
    if planted:
        v[4:7, 4:7] += 40
    return spark.createDataFrame([(r, c, float(v[r, c])) for r in range(12) for c in range(12)],
                                 "row bigint, col bigint, v double"), v


def test_local_statistics_brute_force(spark):
    df, v = block_field(spark)
    z = (v - v.mean()) / (v.std(ddof=1) + 1e-10)
    moran = {(r["row"], r["col"]): r.moran_i for r in A.local_moran(df, "v").collect()}
    gi = {(r["row"], r["col"]): r.gi for r in A.getis_ord(df, "v").collect()}
    n = v.size
    for r in range(12):
        for c in range(12):
            near = [(i, j) for i in range(max(r - 1, 0), min(r + 2, 12)) for j in range(max(c - 1, 0), min(c + 2, 12)) if (i, j) != (r, c)]
            w = len(near)
            assert moran[(r, c)] == pytest.approx(z[r, c] * np.mean([z[p] for p in near]))
            want = (sum(v[p] for p in near) - v.mean() * w) / (v.std(ddof=1) * math.sqrt((n * w - w * w) / (n - 1)))
            assert gi[(r, c)] == pytest.approx(want)


def test_constant_field_and_isolated_cell(spark):
    same = spark.createDataFrame([(r, c, 5.0) for r in range(4) for c in range(4)], "row bigint, col bigint, v double")
    assert {r.gi for r in A.getis_ord(same, "v").collect()} == {0.0}
    lone = spark.createDataFrame([(0, 0, 1.0), (9, 9, 2.0)], "row bigint, col bigint, v double")
    assert {r.moran_i for r in A.local_moran(lone, "v").collect()} == {0.0}


def test_permutation_test_finds_the_planted_block(spark):
    df, _ = block_field(spark)
    out = A.hotspot_analysis(df, "v", "lisa", alpha=0.2, permutations=199)
    again = A.hotspot_analysis(df, "v", "lisa", alpha=0.2, permutations=199)
    first = {(r["row"], r["col"]): (r.p_value, r.cluster_type) for r in out.collect()}
    assert first == {(r["row"], r["col"]): (r.p_value, r.cluster_type) for r in again.collect()}
    assert first[(5, 5)][1] == "HOTSPOT" and first[(5, 5)][0] == pytest.approx(1 / 200)
    assert min(p for p, _ in first.values()) >= 1 / 200
    assert A.hotspot_summary(out).first().status == "COMPUTED"


def test_permutation_is_a_permutation(spark):
    rows = numbered(spark.range(100).select(F.floor(F.col("id") / 10).alias("row"), (F.col("id") % 10).alias("col")), [F.col("row").asc(), F.col("col").asc()])
    assert sorted(r.pos for r in rows.collect()) == list(range(100))


def test_arithmetic_permutation(spark):
    for n in (1, 2, 31, 50):
        rows = A.permuted(spark.range(n).select(F.col("id").alias("pos")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(299)))), n, 42).collect()
        by_rep = {}
        for r in rows:
            by_rep.setdefault(r.rep, {})[r.pos] = r.to
        assert all(sorted(p.values()) == list(range(n)) for p in by_rep.values())
        # Every number is as likely an image as any other, also beside that of its neighbour.
        if n == 50:
            assert 10 < np.mean([p[7] < 25 for p in by_rep.values()]) * 50 < 40
            assert np.mean([abs(p[7] - p[8]) for p in by_rep.values()]) == pytest.approx(17, abs=3)


def test_permuted_sums_cross_tiles(spark):
    """Cells on both sides of tile borders and of zero; p-values of noise spread over 0..1."""
    v = np.random.default_rng(2).normal(50, 1, (40, 70))
    v[30:34, 30:34] += 15
    df = spark.createDataFrame([(r - 5, c - 5, float(v[r, c])) for r in range(40) for c in range(70)], "row bigint, col bigint, v double")
    for method in ("lisa", "getis_ord"):
        p = A.permutation_p(df, "v", method, permutations=19).toPandas().set_index(["row", "col"]).p_value
        assert len(p) == v.size and p.min() == pytest.approx(1 / 20) and p.loc[(26, 26)] == p.min()
        assert p.mean() == pytest.approx(0.5, abs=0.1)


def _sparse_field():
    """Cells on both sides of block borders and of zero, some missing, one alone."""
    draw = np.random.default_rng(5)
    rows = [(r - 3, c + 120, float(draw.normal(50, 3))) for r in range(25) for c in range(20) if draw.random() < 0.8]
    return [*rows, (900, -900, 61.0)]


@pytest.mark.parametrize("method", ["lisa", "getis_ord"])
def test_replicates_are_not_rows(spark, monkeypatch, method):
    """The values that tasks hold give the p-values of the exploded replicates, which are not formed."""
    df = spark.createDataFrame(_sparse_field(), "row bigint, col bigint, v double")
    table = lambda: sorted(map(tuple, A.permutation_p(df, "v", method, permutations=50, chunk=20).collect()))
    rows, held = A._exceedances, A.HELD
    monkeypatch.setattr(A, "HELD", 0)
    want = table()
    monkeypatch.setattr(A, "HELD", held)
    monkeypatch.setattr(A, "_exceedances", None)
    assert [r[:2] + r[3:] for r in table()] == [r[:2] + r[3:] for r in want]
    # A place that comes twice is no cell of a raster; it goes the other way.
    monkeypatch.setattr(A, "_exceedances", rows)
    twice = df.unionByName(df.limit(1))
    assert A.permutation_p(twice, "v", method, permutations=3).count() == df.count() + 3


def test_shifts_are_those_of_the_permutation(spark):
    """The tables that tasks hold give the images that the columns give."""
    for n in (2, 31, 50):
        a, b, tables = A.shifts(n, 40, 42)
        rows = A.permuted(spark.range(n).select(F.col("id").alias("pos")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(39)))), n, 42).collect()
        for r in rows:
            y = r.pos
            while True:
                left, right = divmod(y, b)
                for k, t in enumerate(tables):
                    left, right = ((left + t[r.rep, right]) % a, right) if k % 2 else (left, (right + t[r.rep, left]) % b)
                y = left * b + right
                if y < n:
                    break
            assert y == r.to


def test_constant_cells_have_no_hotspots(spark):
    df = spark.createDataFrame([(r, c, 5.0) for r in range(8) for c in range(8)], "row bigint, col bigint, v double")
    for method in ("lisa", "getis_ord"):
        assert {r.p_value for r in A.permutation_p(df, "v", method, permutations=9).collect()} == {1.0}


def test_registered_permutation_queries_use_the_full_settings(spark, monkeypatch):
    from airq.plans import spatial
    seen, plain = [], A.permutation_p

    def few(cells, value, method, permutations, seed):
        seen.append(permutations)
        return plain(cells, value, method, 19, seed)

    cut, full = [], A.benjamini_hochberg
    monkeypatch.setattr(A, "permutation_p", few)
    monkeypatch.setattr(A, "benjamini_hochberg", lambda df, p, alpha: cut.append(alpha) or full(df, p, alpha))
    for query in (spatial.permutation_hotspots, spatial.permutation_getis_ord):
        query(spark, "/root/testdata/sf0.001").collect()
    assert seen == [999, 999] and cut == [0.05, 0.05]


def test_few_cells_are_deferred_without_replicates(spark, monkeypatch):
    monkeypatch.setattr(A, "permutation_p", None)
    few = spark.createDataFrame([(r, c, 1.0 * r * c) for r in range(5) for c in range(5)], "row bigint, col bigint, v double")
    out = A.hotspot_analysis(few, "v")
    assert out.count() == 25 and {(r.p_value, r.cluster_type, r.significant) for r in out.collect()} == {(None, None, False)}
    assert A.hotspot_summary(out).first().status == "DEFERRED"


def test_scattered_hotspots(spark):
    """Cells on a turned grid: neighbours and statistics as on the grid, a planted block is found."""
    v = np.random.default_rng(8).normal(50, 1, (9, 9))
    v[3:6, 3:6] += 12
    turn = lambda r, c: (28 + 0.01 * (r * 0.8 - c * 0.6), 77 + 0.01 * (r * 0.6 + c * 0.8))
    rows = [(*turn(r, c), float(v[r, c])) for r in range(9) for c in range(9)] + [(None, 77.0, 1.0), (28.0, 77.0, None)]
    table = spark.createDataFrame(rows, "latitude double, longitude double, `PM2.5` double")
    classes, report = scattered_hotspots(table, permutations=199, alpha=0.2)
    got = {(r.method, round(r.latitude, 9), round(r.longitude, 9)): r for r in classes.collect()}
    grid = spark.createDataFrame([(r, c, float(v[r, c])) for r in range(9) for c in range(9)], "row bigint, col bigint, v double")
    moran = {(r["row"], r["col"]): r.moran_i for r in A.local_moran(grid, "v").collect()}
    gi = {(r["row"], r["col"]): r.gi for r in A.getis_ord(grid, "v").collect()}
    for method, want in (("lisa", moran), ("getis_ord", gi)):
        for (r, c), s in want.items():
            lat, lon = turn(r, c)
            assert got[method, round(lat, 9), round(lon, 9)].statistic == pytest.approx(s, abs=1e-6)
    centre = got["lisa", *[round(x, 9) for x in turn(4, 4)]]
    assert (centre.p_value, centre.cluster_type) == (pytest.approx(1 / 200), "HOTSPOT")
    assert {(r.method, r.status, r.n_cells) for r in report.collect()} == {("lisa", "COMPUTED", 81), ("getis_ord", "COMPUTED", 81)}


def test_scattered_hotspots_deferred(spark):
    rows = [(28.0 + i, 77.0, 1.0) for i in range(29)]
    table = spark.createDataFrame(rows, "latitude double, longitude double, `PM2.5` double")
    classes, report = scattered_hotspots(table)
    assert classes.count() == 0 and {(r.status, r.reason) for r in report.collect()} == {("DEFERRED", "insufficient_cells: 29 < 30")}
    classes, report = scattered_hotspots(table.drop("latitude"), methods=("lisa",))
    assert classes.count() == 0 and report.first().reason == "missing_columns: latitude"
    same = spark.createDataFrame([(28.0, 77.0, float(i % 2)) for i in range(40)], "latitude double, longitude double, `PM2.5` double")
    classes, _ = scattered_hotspots(same, permutations=9)
    assert classes.count() == 80


def test_scattered_neighbours(spark):
    pts = spark.createDataFrame([("a", 0.0, 0.0, 1.0), ("b", 0.0, 0.0, 2.0), ("c", 0.5, 0.0, 4.0), ("d", 9.0, 9.0, 8.0)],
                                "id string, x double, y double, v double")
    got = {r.id: (r.nbr_sum, r.nbr_count) for r in A.neighbour_sums_within(pts, "id", ["x", "y"], "v", 1.0).collect()}
    assert got == {"a": (6.0, 2), "b": (5.0, 2), "c": (3.0, 2), "d": (0.0, 0)}


def test_threshold_reads_stored_cells_in_many_tasks(spark, monkeypatch):
    """The search computes its cells once, and levels are made by more tasks than the sites have files."""
    from airq.operators import autocorr, nearest
    seen = {}

    def levels(points, sites, *rest, kept=nearest._levels):
        seen["tasks"] = sites.rdd.getNumPartitions()
        return kept(points, sites, *rest)

    def search(points, *rest, kept=nearest.k_nearest, **named):
        seen["stored"] = "_airq_path" in points.__dict__
        return kept(points, *rest, **named)

    monkeypatch.setattr(nearest, "_levels", levels)
    monkeypatch.setattr(autocorr, "k_nearest", search)
    cells = spark.range(40).select("id", (F.col("id") * F.col("id") / 10.0).alias("x"), F.lit(0.0).alias("y"))
    out = autocorr.queen_threshold(cells, "id", ["x", "y"], 0.1).first().threshold
    gaps = [min(abs(i * i - j * j) / 10.0 for j in range(40) if j != i) for i in range(40)]
    assert out == pytest.approx(1.5 * (sorted(gaps)[19] + sorted(gaps)[20]) / 2)
    assert seen == {"stored": True, "tasks": spark.sparkContext.defaultParallelism}
