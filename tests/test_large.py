"""What would only break at size: joins whose small-looking side is large in memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from airq.operators import autocorr as A, nearest as N, raster as R, reports as RP, scattered as S
from airq.session import materialize


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_probes_of_pixels_are_not_broadcast(spark):
    points = spark.range(40).select("id", (F.col("id") % 8).alias("r"), (F.col("id") % 5).alias("c"))
    pixels = spark.range(30).select((F.col("id") % 6).alias("row"), F.floor(F.col("id") / 6).alias("col"),
                                    F.when(F.col("id") % 3 == 0, F.col("id") * 1.0).alias("value"))
    out = R.nearest_valid_pixel(points, pixels, "r", "c", F.col("c") < 4)
    # The exploded side must meet the pixels by a merge; what is found may still be broadcast.
    assert "SortMergeJoin [row" in plan(out)
    assert out.count() == 40


def test_lines_give_the_nearest_valid_pixel(spark):
    """Against brute force, over the borders of strips and left of column 0; no row for each neighbour of a pixel."""
    points = spark.range(160).select("id", (F.col("id") % 4).alias("r"), (F.floor(F.col("id") / 4) - 4).alias("c"))
    pixels = spark.range(300).select((F.col("id") % 5 - 1).alias("row"), (F.floor(F.col("id") / 5) - 6).alias("col"),
                                     F.when(F.col("id") * 7 % 23 == 0, F.col("id") * 1.0).when(F.col("id") % 2 == 0, F.lit(-1.0)).alias("value"))
    out = R.nearest_valid_pixel(points, pixels, "r", "c", F.col("c") < 30)
    valid = [(p.row, p.col, p.value) for p in pixels.where("value >= 0").collect()]
    for p in out.collect():
        near = sorted((max(abs(y - p.r), abs(x - p.c)), (y - p.r) ** 2 + (x - p.c) ** 2, y - p.r, x - p.c, v)
                      for y, x, v in valid if max(abs(y - p.r), abs(x - p.c)) <= 2) if p.c < 30 else []
        assert p.found == (near[0][4] if near else None), p
    assert "collect_set" in plan(out)


def test_ranks_are_not_broadcast(spark):
    rows = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("a"),
                                   (F.col("id") % 11).cast("double").alias("b"))
    out = RP.correlation_pairs(rows, ["a", "b"], ["k"])
    spearman = out.first()["spearman"]
    want = rows.toPandas()[["a", "b"]].corr("spearman").iloc[0, 1]
    assert abs(spearman - want) < 1e-9
    assert "SortMergeJoin [feature" in out._jdf.queryExecution().toString()


def test_replicates_are_not_broadcast(spark):
    cells = spark.range(40).select(F.col("id").alias("pos"), F.floor(F.col("id") / 8).alias("row"), (F.col("id") % 8).alias("col"),
                                   F.col("id").cast("double").alias("x"), F.lit(0.5).alias("o"))
    moments = cells.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd")).first()
    out = A._exceedances(cells, moments, F.sequence(F.lit(0), F.lit(4)), "lisa", 42)
    assert "BroadcastHashJoin" not in plan(out)
    assert out.count() == 40


def test_scattered_replicates_are_not_broadcast(spark, monkeypatch):
    seen = []

    def watched(df, name):
        if name == "exceedances":
            seen.append(plan(df))
        return materialize(df, name)

    monkeypatch.setattr(S, "materialize", watched)
    cells = spark.range(40).select((F.col("id") % 8).cast("double").alias("latitude"), F.floor(F.col("id") / 8).cast("double").alias("longitude"),
                                   F.col("id").cast("double").alias("PM2.5"))
    S.scattered_hotspots(cells, methods=("lisa",), permutations=9)
    assert seen and not any("BroadcastHashJoin" in p for p in seen)


def test_a_position_is_asked_once_and_meets_lists(spark):
    points = spark.range(2000).select("id", (F.col("id") % 2 * 50.0).alias("x"), F.lit(0.0).alias("y"))
    sites = spark.range(1500).select(F.col("id").alias("sid"), (F.col("id") % 40 / 100.0 + 9.0).alias("x"), (F.col("id") / 4000.0).alias("y"))
    out = N.k_nearest(points, sites, ["x", "y"], 1, "id", "sid", 0.01)
    assert "array_min" in plan(out)
    assert {(r.id % 2, r.sid) for r in out.collect()} == {(0, 0), (1, 39)}
