"""High-pollution zones: 4-neighbour connected components of hot cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from airq.functions.aqi import CATEGORIES, category_rank
from airq.operators.ranks import distinct_value_ranks
from airq.session import discard, materialize, materialize_counting


#: Pointer doublings a round; more of them are wasted, as chains of falling ranks are short.
HOPS = 2


def hotspot_mask(cells: DataFrame, min_category: str = "VERY_POOR",
                 category: str = "aqi_category") -> DataFrame:
    """Cells whose category is at least the given one; unknown cells are out."""
    names = [name for name, _, _ in CATEGORIES["india_cpcb"]]
    return cells.where(category_rank(F.col(category)) >= names.index(min_category))


def _runs(hot: DataFrame, by: list[str]) -> DataFrame:
    """Label every cell with the first cell of its unbroken run along the row.

    ``col - row_number`` is constant inside a run. The window sees one grid row
    of one day, so its size is bounded by the grid width.
    """
    line = Window.partitionBy(*by, "row").orderBy("col")
    marked = hot.withColumn("_g", F.col("col") - F.row_number().over(line))
    run = Window.partitionBy(*by, "row", "_g")
    return marked.withColumn("run_col", F.min("col").over(run)).drop("_g")


def label_zones(hot: DataFrame, width: int, by: list[str] | None = None,
                max_rounds: int = 60) -> DataFrame:
    """Add ``zone``: the smallest scan position (row * width + col) of the component.

    Runs along rows are the nodes; two runs are linked where a cell of one lies
    above a cell of the other (an equi-join). The graph is then contracted: every
    round each node is merged into a neighbour, links are renamed, and those that
    have become loops or repeats are dropped, so a settled zone costs nothing
    more and a large one shrinks by a factor a round. Names travel back through
    the rounds, from few nodes to many, so no zone is ever one join key for all
    its cells. Every round is written to the shared folder, which cuts the
    lineage and survives lost executors.
    """
    by = by or []
    at = F.col("row") * F.lit(width) + F.col("run_col")
    cells = materialize(_runs(hot, by).withColumn("_node", at), "zone-cells")
    below = cells.select(*by, (F.col("row") + 1).alias("row"), "col", F.col("_node").alias("a"))
    links = cells.withColumnRenamed("_node", "b").join(below, [*by, "row", "col"]).select(*by, "a", "b").distinct()
    links, n = materialize_counting(links, "zone-links", F.lit(True))
    levels: list[DataFrame] = []
    while n:
        if len(levels) == max_rounds:
            raise RuntimeError(f"zones did not settle in {max_rounds} rounds")
        levels.append(materialize(_merge(links, levels[-1] if levels else None, by, len(levels)), "zone-level"))
        before, (links, n) = links, materialize_counting(_contracted(links, levels[-1], by), "zone-links", F.lit(True))
        discard(before)
    discard(links)
    named = _names(levels, by)
    if named is None:
        return cells.withColumn("zone", F.col("_node")).drop("_node", "run_col")
    return cells.join(named.withColumnRenamed("node", "_node"), [*by, "_node"], "left").withColumn(
        "zone", F.coalesce("name", "_node")).drop("name", "_node", "run_col")


def _merge(links: DataFrame, last: DataFrame | None, by: list[str], nth: int) -> DataFrame:
    """(node, parent, low) of all nodes that have a link; ``low`` is the smallest first node behind a node.

    Each node points to its neighbour of least rank, if that is below its own, and
    pointers are followed ``HOPS`` times, doubling their reach. Ranks are a hash that
    changes with the round: with scan positions a long column of cells would
    lose one node a round only.
    """
    def ranked(name: str):
        return F.struct(F.xxhash64(name, F.lit(nth)).alias("rank"), F.col(name).alias("id"))

    ends = links.unionByName(links.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
    picked = ends.groupBy(*by, F.col("a").alias("node")).agg(F.min(ranked("b")).alias("_least"))
    merged = picked.select(*by, "node", F.least("_least", ranked("node"))["id"].alias("parent"))
    for _ in range(HOPS):
        further = merged.select(*by, F.col("node").alias("parent"), F.col("parent").alias("_to"))
        merged = merged.join(further, [*by, "parent"]).select(*by, "node", F.col("_to").alias("parent"))
    if last is None:
        return merged.withColumn("low", F.col("node"))
    return merged.join(_lows(last, by).withColumnRenamed("parent", "node"), [*by, "node"])


def _lows(level: DataFrame, by: list[str]) -> DataFrame:
    return level.groupBy(*by, "parent").agg(F.min("low").alias("low"))


def _contracted(links: DataFrame, level: DataFrame, by: list[str]) -> DataFrame:
    """Links between parents, each once."""
    for end in ("a", "b"):
        to = level.select(*by, F.col("node").alias(end), F.col("parent").alias("_to"))
        links = links.join(to, [*by, end]).drop(end).withColumnRenamed("_to", end)
    return links.where("a <> b").select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _names(levels: list[DataFrame], by: list[str]) -> DataFrame | None:
    """(node, name) of the first level: what the last level knows of a zone goes back level by level."""
    named = None
    for level in reversed(levels):
        known = _lows(level, by).withColumnRenamed("low", "name")
        if named is not None:
            later = named.select(*by, F.col("node").alias("parent"), F.col("name").alias("_later"))
            known = known.join(later, [*by, "parent"], "left").select(
                *by, "parent", F.coalesce("_later", "name").alias("name"))
        named = materialize(level.join(known, [*by, "parent"]).select(*by, "node", "name"), "zone-names")
        discard(level)
    return named


def hotspot_zones(labelled: DataFrame, cell_area_km2: float, by: list[str] | None = None) -> DataFrame:
    """One row per zone, numbered in scan order inside each group.

    Cells are reduced to zones first; only zones are numbered. They are stored,
    because numbering reads them twice.
    """
    by = by or []
    zones = labelled.groupBy(*by, "zone").agg(
        F.count(F.lit(1)).alias("n_cells"),
        (F.count(F.lit(1)) * F.lit(cell_area_km2)).alias("area_km2"),
        F.min("row").alias("min_row"), F.max("row").alias("max_row"),
        F.min("col").alias("min_col"), F.max("col").alias("max_col"))
    zones = materialize(zones, "zones")
    numbers = distinct_value_ranks(zones, "zone", by).select(
        *by, F.col("zone").cast("bigint").alias("zone"), (F.col("below") + 1).alias("hotspot_id"))
    return zones.join(numbers, [*by, "zone"]).drop("zone")


def hotspot_statistics(hot: DataFrame, zones: DataFrame, pm25: str, aqi: str) -> DataFrame:
    """Cells, zones, area, mean and maximum of concentration and index."""
    areas = zones.agg(F.count(F.lit(1)).alias("z"), F.sum("area_km2").alias("a"))
    return hot.agg(
        F.count(F.lit(1)).alias("hotspot_cell_count"), F.avg(pm25).alias("mean_pm25"),
        F.max(pm25).alias("max_pm25"), F.avg(aqi).alias("mean_aqi"), F.max(aqi).alias("max_aqi"),
    ).withColumn("_z", areas.select(F.struct("z", "a").alias("s")).scalar()).select(
        "hotspot_cell_count", F.col("_z.z").alias("hotspot_zone_count"),
        F.coalesce(F.col("_z.a"), F.lit(0.0)).alias("hotspot_area_km2"),
        "mean_pm25", "max_pm25", "mean_aqi", "max_aqi")
