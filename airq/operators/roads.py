"""Road lines: validation, cutting at cell borders and densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airq.functions.geo import tile_id
from airq.operators.grid import Grid

# Shorter pieces are rounding noise of a line that only touches a border.
MIN_PIECE_M = 1e-9


def check_roads(roads: DataFrame) -> DataFrame:
    """Add ``reject_reason``: missing or empty geometry, missing class, bad coordinates."""
    coords = F.col("coords")
    finite = F.forall(coords, lambda p: p.x.isNotNull() & p.y.isNotNull()
                      & ~F.isnan(p.x) & ~F.isnan(p.y)
                      & (F.abs(p.x) < float("inf")) & (F.abs(p.y) < float("inf")))
    return roads.withColumn("reject_reason", (
        F.when(coords.isNull(), "missing_geometry")
        .when(F.size(coords) == 0, "empty_geometry")
        .when(F.col("highway").isNull(), "missing_highway")
        .when((F.size(coords) < 2) | ~finite, "invalid_geometry")))


def road_attrition(checked: DataFrame) -> DataFrame:
    reason = F.col("reject_reason")
    names = ["missing_geometry", "empty_geometry", "missing_highway", "invalid_geometry"]
    return checked.agg(
        F.count(F.lit(1)).alias("input_roads"),
        *[F.count(F.when(reason == n, 1)).alias(n) for n in names],
        F.count(F.when(reason.isNull(), 1)).alias("retained_roads"))


def highway_class(highway: Column, is_list: bool = False) -> Column:
    """Class of a road; of several listed classes the first counts."""
    return F.try_element_at(highway, F.lit(1)) if is_list else highway


def filter_highway(roads: DataFrame, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, one-row count of dropped roads). An empty list keeps everything."""
    keep = F.col("highway").isin(*allowed) if allowed else F.lit(True)
    keep = F.coalesce(keep, F.lit(False))
    return roads.where(keep), roads.agg(F.count(F.when(~keep, 1)).alias("dropped_roads"))


def split_segments(roads: DataFrame, *keep: str) -> DataFrame:
    """One row per straight segment: x1, y1, x2, y2."""
    coords = F.col("coords")
    pairs = F.arrays_zip(F.slice(coords, F.lit(1), F.size(coords) - 1).alias("a"),
                         F.slice(coords, F.lit(2), F.size(coords) - 1).alias("b"))
    return roads.where(F.size(coords) >= 2).select(*keep, F.explode(pairs).alias("s")).select(
        *keep, F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"),
        F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def _share(a: Column, d: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Part of [0, 1] in which a + t * d lies between two bounds.

    A line parallel to the bounds lies inside from end to end, because its strip
    was chosen by its own coordinate.
    """
    enter, leave = (low - a) / d, (high - a) / d
    return (F.when(d == 0, 0.0).otherwise(F.least(enter, leave)),
            F.when(d == 0, 1.0).otherwise(F.greatest(enter, leave)))


def _strips(a: Column, b: Column, origin: float, step: float, n: int) -> Column:
    """Numbers of the grid strips between two coordinates, inside the grid."""
    first = F.greatest(F.floor((F.least(a, b) - F.lit(origin)) / F.lit(step)), F.lit(0))
    last = F.least(F.floor((F.greatest(a, b) - F.lit(origin)) / F.lit(step)), F.lit(n - 1))
    return F.when(first <= last, F.sequence(first, last))


def cut_segments(segments: DataFrame, grid: Grid, *keep: str) -> DataFrame:
    """Pieces of segments per cell (row, col, length); outside pieces vanish.

    A segment is spread over the columns it touches, each part over the rows it
    touches; the length in a cell follows from the parameter range. Plain
    arithmetic: no geometry library, no spatial index, no sorting.
    """
    x1, y1 = F.col("x1"), F.col("y1")
    dx, dy = F.col("x2") - x1, F.col("y2") - y1
    parts = segments.withColumns({"_dx": dx, "_dy": dy, "col": F.explode(
        _strips(x1, F.col("x2"), grid.xmin, grid.dx, grid.cols))})
    left = F.lit(grid.xmin) + F.col("col") * F.lit(grid.dx)
    a, b = _share(x1, F.col("_dx"), left, F.least(left + grid.dx, F.lit(grid.xmax)))
    inside = ((F.col("_dx") != 0) | (x1 <= grid.xmax)) & ((F.col("_dy") != 0) | (y1 <= grid.ymax))
    parts = parts.where(inside).withColumns({
        "_t0": F.greatest(a, F.lit(0.0)), "_t1": F.least(b, F.lit(1.0))}).where("_t0 < _t1")
    from_y, to_y = y1 + F.col("_t0") * F.col("_dy"), y1 + F.col("_t1") * F.col("_dy")
    cells = parts.withColumn("row", F.explode(_strips(from_y, to_y, grid.ymin, grid.dy, grid.rows)))
    low = F.lit(grid.ymin) + F.col("row") * F.lit(grid.dy)
    c, d = _share(y1, F.col("_dy"), low, F.least(low + grid.dy, F.lit(grid.ymax)))
    share = F.least(d, F.col("_t1")) - F.greatest(c, F.col("_t0"))
    length = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")) * share
    return cells.select(*keep, "row", "col", length.alias("length_m")).where(
        F.col("length_m") > MIN_PIECE_M)


def road_density(cells: DataFrame, pieces: DataFrame, major: list[str]) -> DataFrame:
    """Road length per cell area, all and major classes; empty cells get 0."""
    sums = pieces.groupBy("row", "col").agg(
        F.sum("length_m").alias("total_road_length_m"),
        F.sum(F.when(F.col("highway").isin(*major), F.col("length_m")).otherwise(0.0))
        .alias("major_road_length_m"))
    out = cells.join(sums, ["row", "col"], "left").fillna(
        0.0, ["total_road_length_m", "major_road_length_m"])
    return out.withColumns({
        "road_density": F.col("total_road_length_m") / F.col("area_km2"),
        "major_road_density": F.col("major_road_length_m") / F.col("area_km2")})


def road_report(density: DataFrame) -> DataFrame:
    """Cells with and without roads and the range of positive densities."""
    d = F.col("road_density")
    positive = F.when(d > 0, d)
    return density.agg(
        F.count(F.lit(1)).alias("n_cells"), F.count(positive).alias("cells_with_roads"),
        F.count(F.when(d == 0, 1)).alias("cells_without_roads"),
        F.min(positive).alias("min_density"), F.max(positive).alias("max_density"),
        F.avg(positive).alias("mean_density"),
        F.sum("total_road_length_m").alias("total_length_m"))


def road_counts_by_tile(points: DataFrame, tiles: DataFrame, size_deg: float = 10.0) -> DataFrame:
    """Road count of the tile a point lies in; absent tile means NULL and false."""
    named = points.withColumn("tile_id", tile_id(F.col("longitude"), F.col("latitude"), size_deg))
    counts = tiles.select("tile_id", F.col("road_segments").cast("double").alias("road_density"))
    return named.join(counts, "tile_id", "left").withColumn(
        "road_density_available", F.col("road_density").isNotNull())
