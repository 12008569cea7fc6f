"""Rasters as pixel tables (row, col, value, ...): statistics and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airq.functions.masks import qa_label
from airq.operators.grid import Grid
from airq.operators.ranks import exact_quantiles
from airq.session import materialize

#: Columns of a list of pixels of one line.
STRIP = 16


def place_pixels(pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """Pixel-centre coordinates from the layer's origin and spacing.

    ``meta`` has one row per layer; its nodata marker becomes NULL. Pixels of a
    layer without a row keep their value and have no coordinates.
    """
    half = F.lit(0.5)
    value = F.col("value")
    return pixels.join(meta, "layer", "left").withColumns({
        "x": F.col("x0") + (F.col("col") + half) * F.col("dx"),
        "y": F.col("y0") + (F.col("row") + half) * F.col("dy"),
        "value": F.when(~F.isnan(value) & ~value.eqNullSafe(F.col("nodata")), value),
    })


def zonal_stats(pixels: DataFrame, cell_row: Column, cell_col: Column,
                value: str = "value", by: list[str] | None = None) -> DataFrame:
    """Mean of valid pixels and valid fraction per cell; the centre decides.

    Partial sums are formed before the shuffle, so a dense cell is one row per
    task. Cells without any pixel are added by :func:`fill_cells`.
    """
    by = by or []
    return pixels.where(cell_row.isNotNull() & cell_col.isNotNull()).groupBy(
        *by, cell_row.alias("row"), cell_col.alias("col")).agg(
        F.avg(value).alias("mean"),
        (F.count(value) / F.count(F.lit(1))).alias("valid_fraction"),
        F.count(value).alias("n_valid"), F.count(F.lit(1)).alias("n_pixels"))


def fill_cells(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """All cells of a grid: no pixel means NULL mean and fraction zero."""
    return cells.join(stats, ["row", "col"], "left").fillna(
        {"valid_fraction": 0.0, "n_valid": 0, "n_pixels": 0})


def layer_stats(pixels: DataFrame, value: str = "value", layer: str = "layer",
                with_median: bool = True) -> DataFrame:
    """Counts, range, mean, population deviation, coverage and median per layer."""
    base = pixels.groupBy(layer).agg(
        F.count(F.lit(1)).alias("total_pixels"), F.count(value).alias("valid_pixels"),
        F.count(F.when(F.col(value).isNull(), 1)).alias("nodata_pixels"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        (F.count(value) * 100.0 / F.count(F.lit(1))).alias("coverage_percent"))
    if not with_median:
        return base
    return base.join(exact_quantiles(pixels, value, {"median": 0.5}, by=[layer]), layer, "left")


def qa_histogram(pixels: DataFrame, qa: str, labels: dict[int, str]) -> DataFrame:
    """Pixels per QA code with its name; unlisted codes are named too."""
    return pixels.groupBy(F.col(qa).alias("qa")).agg(F.count(F.lit(1)).alias("pixels")).withColumn(
        "label", qa_label(F.col("qa"), labels))


def mosaic(pixels: DataFrame, order: str, keys: list[str] | None = None) -> DataFrame:
    """Last layer wins per pixel, including its missing values."""
    keys = keys or ["row", "col"]
    rest = [c for c in pixels.columns if c not in keys and c != order]
    top = F.max_by(F.struct(*rest), F.col(order)).alias("_top")
    return pixels.groupBy(*keys).agg(top).select(*keys, *[F.col(f"_top.{c}") for c in rest])


def clip(pixels: DataFrame, inside: Column, value: str = "value") -> DataFrame:
    """Missing outside the area of interest; the extent is kept."""
    return pixels.withColumn(value, F.when(inside, F.col(value)))


def rasterize(cells: DataFrame, grid_cells: DataFrame, value: str, nodata: float) -> DataFrame:
    """Dense pixel table of a cell table, holes filled with the nodata value."""
    dense = grid_cells.select("row", "col").join(cells.select("row", "col", value),
                                                 ["row", "col"], "left")
    return dense.withColumn(value, F.coalesce(value, F.lit(nodata)))


def _corner_table(field: DataFrame, value: str) -> DataFrame:
    """Per lower-left pixel the values of the four pixels around its cell."""
    spread = F.explode(F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj"))
                                 for i in (0, 1) for j in (0, 1)]))
    moved = field.select("row", "col", F.col(value).alias("_v"), spread.alias("o")).select(
        (F.col("row") - F.col("o.di")).alias("_r0"), (F.col("col") - F.col("o.dj")).alias("_c0"),
        "_v", (F.col("o.di") * 2 + F.col("o.dj")).alias("k"))
    return moved.groupBy("_r0", "_c0").agg(
        *[F.max(F.when(F.col("k") == k, F.col("_v"))).alias(f"_v{k}") for k in range(4)])


def interpolate_bilinear(points: DataFrame, field: DataFrame, grid: Grid, x: str, y: str,
                         value: str, out: str) -> DataFrame:
    """Bilinear value of a regular field at points; NULL outside or next to a gap.

    ``field`` holds one value per node (row, col); node (0, 0) lies at the
    grid's lower-left corner. The four nodes are brought together on the field
    side, so every point meets exactly one row.
    """
    fx = (F.col(x) - F.lit(grid.xmin)) / F.lit(grid.dx)
    fy = (F.col(y) - F.lit(grid.ymin)) / F.lit(grid.dy)
    last_c, last_r = grid.cols - 1, grid.rows - 1
    # A point on the closing edge belongs to the last cell.
    c0 = F.least(F.floor(fx), F.lit(last_c - 1))
    r0 = F.least(F.floor(fy), F.lit(last_r - 1))
    inside = fx.between(0, last_c) & fy.between(0, last_r)
    placed = points.withColumns({
        "_r0": F.when(inside, r0), "_c0": F.when(inside, c0), "_fx": fx - c0, "_fy": fy - r0})
    u, v = F.col("_fx"), F.col("_fy")
    one = F.lit(1.0)
    blend = (F.col("_v0") * (one - u) * (one - v) + F.col("_v1") * u * (one - v)
             + F.col("_v2") * (one - u) * v + F.col("_v3") * u * v)
    corners = materialize(_corner_table(field, value), "corners")
    joined = placed.join(corners, ["_r0", "_c0"], "left")
    return joined.withColumn(out, blend).drop(
        "_r0", "_c0", "_fx", "_fy", "_v0", "_v1", "_v2", "_v3")


def sample_layer(points: DataFrame, pixels: DataFrame, grid: Grid, x: str, y: str,
                 value: str, out: str, method: str = "nearest") -> DataFrame:
    """Layer value at points: nearest for classes, bilinear between pixel centres."""
    if method == "nearest":
        lookup = pixels.select(F.col("row").alias("_pr"), F.col("col").alias("_pc"),
                               F.col(value).alias(out))
        placed = points.withColumns({"_pr": grid.row_of(F.col(y)), "_pc": grid.col_of(F.col(x))})
        return placed.join(lookup, ["_pr", "_pc"], "left").drop("_pr", "_pc")
    if method == "bilinear":
        nodes = Grid(grid.xmin + grid.dx / 2, grid.ymin + grid.dy / 2, grid.dx, grid.dy,
                     grid.rows, grid.cols, grid.xmax - grid.dx / 2, grid.ymax - grid.dy / 2)
        return interpolate_bilinear(points, pixels, nodes, x, y, value, out)
    raise ValueError(f"unknown resampling method {method!r}")


def warp(target_cells: DataFrame, pixels: DataFrame, source_grid: Grid, value: str,
         method: str = "bilinear") -> DataFrame:
    """Resample a layer onto other cells, whose centroids are in source coordinates."""
    return sample_layer(target_cells, pixels, source_grid, "cx", "cy", value, value, method)


def sample_points(points: DataFrame, pixels: DataFrame, grid: Grid, x: str, y: str,
                  value: str = "value") -> DataFrame:
    """Batch point query: value and status valid / NoData / outside."""
    out = sample_layer(points, pixels, grid, x, y, value, "sampled")
    inside = grid.row_of(F.col(y)).isNotNull() & grid.col_of(F.col(x)).isNotNull()
    return out.withColumn("status", F.when(~inside, "outside")
                          .when(F.col("sampled").isNull(), "NoData").otherwise("valid"))


def nearest_valid_pixel(points: DataFrame, pixels: DataFrame, row: str, col: str,
                        in_raster: Column, value: str = "value", radius: int = 2) -> DataFrame:
    """Value of the pixel, or of the nearest valid pixel in growing square rings.

    Inside a ring the smallest straight distance wins, then scan order. The valid
    pixels of a line are lists of ``STRIP`` columns and what reaches into them, so the
    pixels asked for meet one list a line and not one row a neighbour.
    """
    strip = lambda c: F.floor(c / STRIP)
    asked = points.where(in_raster).groupBy(F.col(row).alias("_ar"), strip(F.col(col)).alias("_strip")).agg(F.collect_set(col).alias("_cols"))
    valid = pixels.where((F.col(value) >= 0) & (F.col(value) < float("inf")))
    lines = valid.select("row", "col", F.col(value).alias("_v"), F.explode(F.sequence(
        strip(F.col("col") - radius), strip(F.col("col") + radius))).alias("_strip")).groupBy("row", "_strip").agg(
        F.collect_list(F.struct("col", "_v")).alias("_line"))
    probes = asked.select("_ar", "_strip", F.explode(F.array(*map(F.lit, range(-radius, radius + 1)))).alias("_dr")).withColumn("row", F.col("_ar") + F.col("_dr"))
    # Spark takes an exploded table for as small as what it came from and would broadcast it.
    around = probes.hint("merge").join(lines, ["row", "_strip"]).groupBy("_ar", "_strip").agg(F.collect_list(F.struct("_dr", "_line")).alias("_lines"))
    each = asked.hint("merge").join(around, ["_ar", "_strip"]).select("_ar", F.explode("_cols").alias("_ac"), "_lines")

    def reached(line: Column) -> Column:
        dr = line["_dr"]

        def placed(p: Column) -> Column:
            dc = p["col"] - F.col("_ac")
            return F.struct(F.greatest(F.abs(dr), F.abs(dc)).alias("ring"), (dr * dr + dc * dc).alias("d2"), dr.alias("dr"), dc.alias("dc"), p["_v"].alias("v"))

        return F.array_min(F.transform(F.filter(line["_line"], lambda p: F.abs(p["col"] - F.col("_ac")) <= radius), placed))

    found = each.select("_ar", "_ac", F.array_min(F.filter(F.transform("_lines", reached), lambda b: b.isNotNull())).alias("_best")).where(
        "_best is not null").withColumn("found", F.col("_best.v"))
    joined = points.join(found, (F.col(row) == F.col("_ar")) & (F.col(col) == F.col("_ac")), "left")
    hit = F.col("_best").isNotNull()
    return joined.withColumns({
        "status": F.when(~in_raster, "OUTSIDE_RASTER").when(hit, "AVAILABLE")
        .otherwise("NO_VALID_OBSERVATION"),
        "lookup": F.when(hit & (F.col("_best.ring") > 0), "nearest_valid_pixel")
        .otherwise("exact_pixel"),
        "distance_pixels": F.coalesce(F.rint(F.sqrt(F.col("_best.d2"))).cast("int"), F.lit(0)),
    }).drop("_ar", "_ac", "_best")
