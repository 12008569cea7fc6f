"""Regular grids: cells are (row, col) numbers, so containment is arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Grid:
    """A regular grid: lower-left corner, cell size, number of rows and columns."""

    xmin: float
    ymin: float
    dx: float
    dy: float
    rows: int
    cols: int
    xmax: float
    ymax: float
    digits: int = 3
    prefix: str = ""

    @classmethod
    def covering(cls, bounds: tuple[float, float, float, float], res: float,
                 digits: int = 3) -> "Grid":
        """Cells of exactly ``res`` that cover the bounds; edge cells are clipped."""
        xmin, ymin, xmax, ymax = bounds
        return cls(xmin, ymin, res, res, math.ceil((ymax - ymin) / res),
                   math.ceil((xmax - xmin) / res), xmax, ymax, digits)

    @classmethod
    def dividing(cls, bounds: tuple[float, float, float, float], res: float,
                 prefix: str = "") -> "Grid":
        """Cells of about ``res`` that divide the bounds evenly."""
        xmin, ymin, xmax, ymax = bounds
        cols = max(1, round((xmax - xmin) / res))
        rows = max(1, round((ymax - ymin) / res))
        return cls(xmin, ymin, (xmax - xmin) / cols, (ymax - ymin) / rows,
                   rows, cols, xmax, ymax, 5, prefix)

    def row_of(self, y: Column) -> Column:
        row = F.floor((y - F.lit(self.ymin)) / F.lit(self.dy))
        return F.when((row >= 0) & (row < self.rows) & (y <= self.ymax), row)

    def col_of(self, x: Column) -> Column:
        col = F.floor((x - F.lit(self.xmin)) / F.lit(self.dx))
        return F.when((col >= 0) & (col < self.cols) & (x <= self.xmax), col)

    def cell_id(self, row: Column, col: Column) -> Column:
        """Name built from the cell's own row and column."""
        pattern = f"%0{self.digits}d_%0{self.digits}d"
        if self.prefix:
            return F.format_string(f"{self.prefix}::{pattern}", row, col)
        return F.format_string(pattern, col, row)


def make_grid(spark: SparkSession, grid: Grid) -> DataFrame:
    """All cells with bounds, centroid and area; generated in parallel.

    The cell number is split into row and column, so no product of two frames
    is formed and nothing passes through the driver.
    """
    n = F.col("id")
    left = F.lit(grid.xmin) + F.col("col") * F.lit(grid.dx)
    low = F.lit(grid.ymin) + F.col("row") * F.lit(grid.dy)
    cells = spark.range(grid.rows * grid.cols).select(
        F.floor(n / grid.cols).alias("row"), F.pmod(n, F.lit(grid.cols)).alias("col"))
    cells = cells.select(
        "row", "col", left.alias("xmin"), low.alias("ymin"),
        F.least(left + grid.dx, F.lit(grid.xmax)).alias("xmax"),
        F.least(low + grid.dy, F.lit(grid.ymax)).alias("ymax"))
    width, height = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    return cells.where((width > 0) & (height > 0)).select(
        grid.cell_id(F.col("row"), F.col("col")).alias("grid_id"), "*",
        (F.col("xmin") + width / 2.0).alias("cx"), (F.col("ymin") + height / 2.0).alias("cy"),
        (width * height / 1e6).alias("area_km2"))


def assign_cell(points: DataFrame, grid: Grid, x: str, y: str,
                outside: str | None = None) -> DataFrame:
    """Add ``cell_row``, ``cell_col`` and ``grid_id`` of the containing cell.

    Outside the grid the numbers are NULL and the name is ``outside``.
    """
    placed = points.withColumns({"_r": grid.row_of(F.col(y)), "_c": grid.col_of(F.col(x))})
    inside = F.col("_r").isNotNull() & F.col("_c").isNotNull()
    return placed.withColumns({
        "cell_row": F.when(inside, F.col("_r")), "cell_col": F.when(inside, F.col("_c")),
        "grid_id": F.when(inside, grid.cell_id(F.col("_r"), F.col("_c"))).otherwise(F.lit(outside)),
    }).drop("_r", "_c")


def assign_parent(cells: DataFrame, factor: int) -> DataFrame:
    """Parent numbers of cells on a grid nested ``factor`` times in a coarser one."""
    return cells.withColumns({
        "parent_row": F.floor(F.col("row") / factor), "parent_col": F.floor(F.col("col") / factor)})


def join_static_layer(cells: DataFrame, layer: DataFrame, layer_grid: Grid,
                      value: str) -> DataFrame:
    """Value of the layer cell that contains each cell's centroid."""
    placed = assign_cell(cells, layer_grid, "cx", "cy").drop("grid_id")
    lookup = layer.select(F.col("row").alias("cell_row"), F.col("col").alias("cell_col"), value)
    return placed.join(lookup, ["cell_row", "cell_col"], "left").drop("cell_row", "cell_col")


def make_tiles(spark: SparkSession, bounds: tuple[float, float, float, float],
               size_deg: float = 10.0, overlap_deg: float = 0.0) -> DataFrame:
    """Tiles covering a box; they overlap except at the outer edge."""
    if size_deg <= 0 or overlap_deg < 0:
        raise ValueError("size_deg must be > 0 and overlap_deg >= 0")
    west, south, east, north = bounds
    nx = math.ceil((east - west) / size_deg - 1e-9)
    ny = math.ceil((north - south) / size_deg - 1e-9)
    lon = F.lit(west) + F.col("ix") * size_deg
    lat = F.lit(south) + F.col("iy") * size_deg
    return spark.range(nx * ny).select(
        F.floor(F.col("id") / ny).alias("ix"), F.pmod("id", F.lit(ny)).alias("iy")
    ).select(
        F.format_string("tile_%03d_%03d", "ix", "iy").alias("tile_id"),
        F.greatest(F.lit(west), lon - overlap_deg).alias("west"),
        F.greatest(F.lit(south), lat - overlap_deg).alias("south"),
        F.least(F.lit(east), lon + size_deg + overlap_deg).alias("east"),
        F.least(F.lit(north), lat + size_deg + overlap_deg).alias("north"))


def tiles_intersecting(tiles: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Tiles that overlap a box; touching edges do not count."""
    west, south, east, north = bounds
    return tiles.where((F.col("west") < east) & (F.col("east") > west)
                       & (F.col("south") < north) & (F.col("north") > south))


def grid_date_scaffold(cells: DataFrame, start: str, end: str) -> DataFrame:
    """Every cell on every day of an inclusive range; days are generated per row."""
    return cells.withColumn("date", F.explode(F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"))))


def grid_dates_of(cells: DataFrame, dated: DataFrame, date: str = "date") -> DataFrame:
    """Every cell on every distinct day of another table.

    The day list is bounded by the calendar and enters as one scalar array.
    """
    days = dated.agg(F.array_sort(F.collect_set(date)).alias("d"))
    return cells.withColumn("_days", days.scalar()).withColumn(
        "date", F.explode("_days")).drop("_days")
