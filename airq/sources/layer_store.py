"""Pixel layers stored by layer, year and tile of rows, and read by window.

Tiles far from row 0 share a folder: a folder begins at a tile of ``LEADING`` binary digits followed by zeros and ends
before the next such tile. Tiles below 2**LEADING have their own; each doubling of the rows adds 2**(LEADING-1) folders,
so their number does not grow with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of a tile.
TILE_ROWS = 256
PARTS = ["layer", "year", "row_tile"]
#: Binary digits of a tile's number that tell its folder.
LEADING = 5


def folder_of(tile: int) -> int:
    """The first tile of the folder that holds a tile; it never falls as tiles rise."""
    far = abs(tile)
    first = far - far % (1 << max(0, far.bit_length() - LEADING))
    return first if tile >= 0 else -first


def _folder(tile: Column) -> Column:
    far = F.abs(tile).cast("long")
    width = F.pow(F.lit(2), F.greatest(F.length(F.bin(far)) - LEADING, F.lit(0))).cast("long")
    return (F.signum(tile) * (far - far % width)).cast("int")


def write_layers(pixels: DataFrame, path: str, tile_rows: int = TILE_ROWS, files: int = 1) -> None:
    """Store (layer, obs_date, row, col, value, ...), in folders by layer, year and tile.

    A folder's pixels come from ``files`` tasks; inside a file they lie by tile, date
    and place, so that row groups and pages can be skipped too. Pixels without layer, date or row
    have no place in the store and are refused.
    """
    placed = pixels.withColumns({
        "year": F.year("obs_date"), "row_tile": _folder(F.floor(F.col("row") / tile_rows))})
    for c in ("layer", "obs_date", "row"):
        placed = placed.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a pixel without {c}")).cast(placed.schema[c].dataType)).otherwise(F.col(c)))
    spread = [F.pmod(F.xxhash64("row", "col"), F.lit(files))] if files > 1 else []
    inside = [F.floor(F.col("row") / tile_rows), "obs_date", "row", "col"]
    placed.repartition(*PARTS, *spread).sortWithinPartitions(*PARTS, *inside).write.partitionBy(*PARTS).parquet(path)


def read_window(spark: SparkSession, path: str, layers: list[str], first: str, last: str, rows: tuple[int, int],
                tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pixels of the layers between two days and two rows, both included; other folders are not listed for reading."""
    year = F.col("year").between(int(first[:4]), int(last[:4]))
    tile = F.col("row_tile").between(*(folder_of(r // tile_rows) for r in rows))
    exact = F.col("obs_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & F.col("row").between(*rows)
    return spark.read.parquet(path).where(F.col("layer").isin(*layers) & year & tile & exact)


def read_windows(store: DataFrame, windows: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pixels in any window of a table (window_id, layer, first, last, row_from, row_to), one row per pixel and window.

    A window is spread over its years and folders and joined by folder, so Spark
    prunes the folders at run time by what the windows name. NULL ends hold nothing.
    """
    asked = windows.where("first <= last and row_from <= row_to").withColumn("year", F.explode(F.sequence(F.year("first"), F.year("last")))).withColumn(
        "row_tile", F.explode(F.array_distinct(F.transform(
            F.sequence(F.floor(F.col("row_from") / tile_rows), F.floor(F.col("row_to") / tile_rows)), _folder))))
    met = store.join(asked, PARTS).where(F.col("obs_date").between(F.col("first"), F.col("last")) & F.col("row").between(F.col("row_from"), F.col("row_to")))
    return met.select("window_id", *store.columns)
