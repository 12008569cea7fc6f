"""Joins with polygons and rectangles that are tables themselves, by cells of sizes that fit each shape.

A shape belongs to the level whose cells are about as large as it is, so it covers
few cells there however large it is. What is compared is found by equal cells, and
no pair of things far apart is formed. Levels are powers of two of ``base``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airq.operators.pairs import PIECE, join_by_pairs
from airq.session import materialize

#: Cells along the longer side of a polygon's bounds, about: in any case, and at most where many points are near.
ACROSS, FINE = 4, 32
#: Points of a cell of those, about; edges of a polygon times cells across, at most, beyond ``ACROSS``.
POINTS, EDGES = 256, 1 << 17
EDGE, CELL = ["x1", "y1", "x2", "y2"], ["level", "band", "cell"]
#: Smallest side, as a power of two of ``base``, that tells levels apart.
FINEST = -20


def _level(side: Column, base: float, across: int = 1) -> Column:
    """The least level whose cells times ``across`` are no smaller than ``side``."""
    return F.greatest(F.ceil(F.log2(F.greatest(side / (base * across), F.lit(2.0 ** FINEST)))), F.lit(FINEST)).cast("int")


def _size(level: Column, base: float) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), level)


def _cell(x: Column, size: Column) -> Column:
    return F.floor(x / size)


def _levels(df: DataFrame) -> Column:
    """The levels that occur, as an array literal: at most as many as doubles have exponents."""
    found = sorted(r["level"] for r in df.select("level").distinct().collect())
    return F.array(*map(F.lit, found)).cast("array<int>")


# ------------------------------------------------------------------ polygons


def polygon_edges(polygons: DataFrame, polygon_id: str, rings: str) -> DataFrame:
    """(id, x1, y1, x2, y2): every edge of every ring.

    ``rings`` is an array of rings, each an array of (x, y); outer rings and holes are
    treated alike. Rings are closed where they are open; rings of fewer than three
    points, NULL rings and polygons without an id count as nothing.
    """
    ring = polygons.where(F.col(polygon_id).isNotNull()).select(F.col(polygon_id).alias("id"), F.explode(rings).alias("ring")).where(F.size("ring") >= 3)
    points = F.concat("ring", F.slice("ring", 1, 1))
    edge = F.explode(F.arrays_zip(F.col("ring").alias("a"), F.slice(points, F.lit(2), F.size("ring")).alias("b")))
    known = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    return ring.select("id", edge.alias("e")).select("id", *[known(f"e.{end}.{c}").alias(f"{c}{k}") for k, end in ((1, "a"), (2, "b")) for c in "xy"])


def _at_levels(points: DataFrame, shapes: DataFrame, base: float) -> DataFrame:
    """The points in their cell at each level of the shapes."""
    size = _size(F.col("level"), base)
    return points.withColumn("level", F.explode(_levels(shapes))).withColumns({"band": _cell(F.col("y"), size), "cell": _cell(F.col("x"), size)})


def _with_levels(edges: DataFrame, points: DataFrame, base: float) -> DataFrame:
    """(id, level, fine, broken) of polygons with points around: the more points lie in its bounds, the finer the cells of a polygon."""
    lacks = F.greatest(*[F.col(c).isNull() for c in EDGE])
    bounds = materialize(edges.groupBy("id").agg(
        F.min(F.least("x1", "x2")).alias("west"), F.min(F.least("y1", "y2")).alias("south"), F.max(F.greatest("x1", "x2")).alias("east"),
        F.max(F.greatest("y1", "y2")).alias("north"), F.count(F.lit(1)).alias("edges"), F.max(lacks).alias("broken")).withColumn(
        "level", _level(F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south")), base, ACROSS)), "bounds")
    size = _size(F.col("level"), base)
    laid = bounds.withColumn("band", F.explode(F.sequence(_cell(F.col("south"), size), _cell(F.col("north"), size)))).withColumn(
        "cell", F.explode(F.sequence(_cell(F.col("west"), size), _cell(F.col("east"), size))))
    held = _at_levels(points, bounds, base).groupBy(*CELL).agg(F.count(F.lit(1)).alias("points"))
    # Exploded rows are more than Spark takes them for; the hint keeps them from being broadcast.
    around = laid.hint("merge").join(held, CELL).groupBy("id", "level", "edges", "broken").agg(F.sum("points").alias("points"))
    across = F.least(F.sqrt(F.col("points") / POINTS), F.lit(EDGES) / F.col("edges"), F.lit(float(FINE)))
    halved = F.when(F.col("broken"), 0).otherwise(F.greatest(F.floor(F.log2(across / ACROSS)), F.lit(0)))
    return around.withColumn("halved", halved).select(
        "id", "broken", (F.col("halved") > 0).alias("fine"), F.greatest(F.col("level") - F.col("halved"), F.lit(FINEST)).cast("int").alias("level"))


def polygon_cover(edges: DataFrame, points: DataFrame, base: float) -> DataFrame:
    """(id, level, band, cell, fine, odd, n, kept): what is to be known of a polygon in each cell where it may hold points.

    An edge touches the cells that it runs through in a band of latitude. Between touched
    cells a polygon holds all points of a cell or none, so nothing is kept and ``odd`` says
    which. In a touched cell edges are ``kept`` that a point there may or may not meet on
    its way to the right; ``odd`` counts those that all points meet. A margin far above
    the error of the arithmetic makes edges touch. A polygon that lacks a corner is not
    closed: all its edges are kept in all cells from its leftmost edge of the band.
    """
    size = _size(F.col("level"), base)
    margin = size * 1e-9 + sum(F.abs(c) for c in EDGE) * 1e-13
    low, high, left, right = F.least("y1", "y2"), F.greatest("y1", "y2"), F.least("x1", "x2"), F.greatest("x1", "x2")
    placed = edges.dropna().join(_with_levels(edges, points, base), "id").withColumn("band", F.explode(F.sequence(_cell(low - margin, size), _cell(high + margin, size))))
    floor, roof = F.col("band") * size - margin, (F.col("band") + 1) * size + margin
    dy = F.col("y2") - F.col("y1")
    at = lambda y: F.when(dy != 0, F.col("x1") + (y - F.col("y1")) * ((F.col("x2") - F.col("x1")) / dy))
    placed = placed.withColumns({"_a": at(F.greatest(low, floor)), "_b": at(F.least(high, roof))})
    begin, end = F.greatest(left, F.least("_a", "_b")), F.least(right, F.greatest("_a", "_b"))
    begin, end = F.when(F.col("broken") | (dy == 0), left).otherwise(begin), F.when(F.col("broken") | (dy == 0), right).otherwise(end)
    through = (low <= floor) & (high >= roof) & ~F.col("broken")
    bands = placed.select("id", "level", "band", "fine", "broken", F.struct(
        _cell(begin - margin, size).alias("a"), _cell(end + margin, size).alias("b"), through.alias("through"), *EDGE).alias("e")).groupBy(
        "id", "level", "band", "fine", "broken").agg(F.collect_list("e").alias("es"))
    every = F.sequence(F.array_min(F.transform("es", lambda e: e["a"])), F.array_max(F.transform("es", lambda e: e["b"])))
    touched = F.array_sort(F.array_distinct(F.flatten(F.transform("es", lambda e: F.sequence(e["a"], e["b"])))))
    bands = bands.withColumn("touched", F.when(F.col("broken"), every).otherwise(touched))
    gaps = F.transform("touched", lambda c, i: F.struct((c + 1).alias("a"), (F.get("touched", i + 1) - 1).alias("b"), F.lit(False).alias("met")))
    runs = F.concat(F.transform("touched", lambda c: F.struct(c.alias("a"), c.alias("b"), F.lit(True).alias("met"))), F.filter(gaps, lambda g: g["b"] >= g["a"]))
    middle = (F.col("band") + 0.5) * size
    runs = bands.withColumn("r", F.explode(runs)).withColumn("a", F.col("r.a"))
    beyond = lambda e: e["a"] > F.col("a")
    straddles = lambda e: (e["y1"] > middle) != (e["y2"] > middle)
    kept = F.filter("es", lambda e: F.when(F.col("broken"), e["b"] >= F.col("a")).otherwise(
        F.col("r.met") & (e["b"] >= F.col("a")) & ~(beyond(e) & e["through"])))
    met = F.filter("es", lambda e: beyond(e) & ~F.col("broken") & F.when(F.col("r.met"), e["through"]).otherwise(straddles(e)))
    runs = runs.withColumns({"kept": F.transform(kept, lambda e: F.struct(*[e[c].alias(c) for c in EDGE])), "odd": F.size(met) % 2 == 1})
    runs = runs.withColumn("n", F.size("kept")).where(F.col("odd") | (F.col("n") > 0))
    return runs.select("id", "level", "band", F.explode(F.sequence("r.a", "r.b")).alias("cell"), "fine", "odd", "n", "kept")


def _crossed(x1: str, y1: str, x2: str, y2: str) -> tuple[Column, Column]:
    """Whether the edge lies to the right of the point, at its latitude; whether the point is on the edge."""
    dx, dy = F.col(x2) - F.col(x1), F.col(y2) - F.col(y1)
    turn = (F.col("x") - F.col(x1)) * dy - (F.col("y") - F.col(y1)) * dx
    on = (turn == 0) & F.col("x").between(F.least(x1, x2), F.greatest(x1, x2)) & F.col("y").between(F.least(y1, y2), F.greatest(y1, y2))
    # The edge lies to the right where it straddles the point's latitude and turns the right way.
    return ((F.col(y1) > F.col("y")) != (F.col(y2) > F.col("y"))) & F.when(dy > 0, turn < 0).otherwise(turn > 0), on


def points_in_polygons(points: DataFrame, point_id: str, x: str, y: str, polygons: DataFrame, polygon_id: str, rings: str,
                       base: float = 1.0) -> DataFrame:
    """(point_id, polygon_id) of every point strictly inside a polygon of a table (even-odd rule, no boundary).

    Polygons are laid into cells, finer ones where many points are near. Points of a cell
    that lies inside meet the polygon without a test; where one or two edges matter in a
    fine cell, they are tested in the join. Elsewhere edges that a point neither crosses nor
    touches on its way to the right are dropped where they meet, and the others are counted
    in the same task. Pairs are not shuffled; a crowded cell is cut. Points without an id or a
    coordinate are in no polygon. Ids must be unique: what comes an even number of times is nowhere.
    """
    edges = materialize(polygon_edges(polygons, polygon_id, rings), "edges")
    known = points.where(F.col(point_id).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(point_id).alias("point"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    known = materialize(known.where(~F.isnan("x") & ~F.isnan("y")).groupBy("point", "x", "y").agg(F.count(F.lit(1)).alias("_n")).where(
        "_n % 2 = 1").drop("_n"), "asked")
    cover = polygon_cover(edges, known, base)
    corner = lambda i, c: F.coalesce(F.get("kept", F.lit(i))[c], F.lit(float("nan")))
    few = (F.col("n") == 0) | (F.col("fine") & (F.col("n") <= 2))
    cover = materialize(cover.select("id", *CELL, "fine", "odd", "n", F.when(~few, F.col("kept")).alias("kept"), *[
        F.when(few, corner(i, c)).otherwise(float("nan")).alias(f"{k}{c}") for i, k in enumerate("pq") for c in EDGE]), "cover")
    direct, counted = cover.where(few).drop("kept", "fine"), cover.where(~few)
    # What all points of the cell meet is an edge far to the right.
    far = F.array(F.struct(*[F.lit(v).alias(c) for c, v in zip(EDGE, (1e150, -1e150, 1e150, 1e150))]))
    counted = counted.select("id", *CELL, F.explode(F.concat("kept", F.when(F.col("odd"), far).otherwise(F.slice(far, 1, 0)))).alias("e")).select("id", *CELL, "e.*")
    right, on = _crossed(*EDGE)
    met = join_by_pairs(_at_levels(known, counted, base), counted, CELL, whole="id")
    found = met.where(right | on).select(*CELL, *PIECE, "point", "id", right.alias("right"), on.alias("on")).groupBy(
        *CELL, *PIECE, "point", "id").agg(F.count(F.when(F.col("right"), 1)).alias("crossings"), F.max("on").alias("on"))
    found = found.where((F.col("crossings") % 2 == 1) & ~F.col("on"))
    (p, on_p), (q, on_q) = (_crossed(*[f"{k}{c}" for c in EDGE]) for k in "pq")
    # An edge that is not there has corners of NaN, which is crossed by nothing.
    inside = ((F.col("odd") != p) != q) & ~on_p & ~on_q
    # A cell holds fewer points than polygons, and the pairs of one row of the left side are held at a time.
    sure = join_by_pairs(direct, _at_levels(known, direct, base), CELL).where((F.col("n") == 0) | inside)
    return found.select("point", "id").unionByName(sure.select("point", "id")).select(F.col("point").alias(point_id), F.col("id").alias(polygon_id))


# ---------------------------------------------------------------- rectangles

BOX = ["west", "south", "east", "north"]


def read_tile_index(spark, path: str) -> DataFrame:
    """(tile_id, west, south, east, north) of a stored index; columns go by name, what is no box is left out."""
    index = spark.read.parquet(path)
    boxes = index.select(F.col("tile_id").cast("string").alias("tile_id"), *[F.col(c).cast("double").alias(c) for c in BOX])
    return boxes.where("tile_id is not null and west < east and south < north")


def _placed(boxes: DataFrame, name: str, key: str, base: float) -> DataFrame:
    side = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))
    whole = boxes.where(F.col(key).isNotNull() & (F.col("west") < F.col("east")) & (F.col("south") < F.col("north")))
    return materialize(whole.select(F.col(key).alias(f"{name}_id"), *[F.col(c).cast("double").alias(f"{name}_{c}") for c in BOX],
                                    _level(side, base).alias("level")), name)


def _covering(placed: DataFrame, name: str, at: Column, base: float) -> DataFrame:
    """The box in each cell that it touches at the levels ``at``: four cells a level at most."""
    box = placed.withColumnRenamed("level", "own").withColumn("level", F.explode(at))
    size = _size(F.col("level"), base)
    rows = F.sequence(_cell(F.col(f"{name}_south"), size), _cell(F.col(f"{name}_north"), size))
    cols = F.sequence(_cell(F.col(f"{name}_west"), size), _cell(F.col(f"{name}_east"), size))
    return box.withColumn("row", F.explode(rows)).withColumn("col", F.explode(cols)).drop("own")


def boxes_intersecting(tiles: DataFrame, tile_id: str, areas: DataFrame, area_id: str, base: float = 1.0) -> DataFrame:
    """(tile_id, area_id) of every tile and area whose boxes overlap; boxes that only touch do not.

    A pair is compared at the level of the larger box, where both touch four cells at
    most, and reported by the cell that holds the lower left corner of what they
    share, so no pair comes twice and nothing needs to be made distinct. NULL or empty
    boxes and NULL ids meet nothing; equal rows are rows of their own.
    """
    a, b = _placed(tiles, "a", tile_id, base), _placed(areas, "b", area_id, base)
    above = lambda levels: F.filter(levels, lambda v: v > F.col("own"))
    from_own = lambda levels: F.filter(levels, lambda v: v >= F.col("own"))
    own = F.array("own")
    tile_levels, area_levels = _levels(a), _levels(b)
    keys = ["level", "row", "col"]
    # Tiles at least as large as the area, then areas larger than the tile.
    pairs = join_by_pairs(_covering(a, "a", own, base), _covering(b, "b", from_own(tile_levels), base), keys).unionByName(
        join_by_pairs(_covering(a, "a", above(area_levels), base), _covering(b, "b", own, base), keys))
    overlap = ((F.col("a_west") < F.col("b_east")) & (F.col("b_west") < F.col("a_east"))
               & (F.col("a_south") < F.col("b_north")) & (F.col("b_south") < F.col("a_north")))
    size = _size(F.col("level"), base)
    owner = (_cell(F.greatest("a_west", "b_west"), size) == F.col("col")) & (_cell(F.greatest("a_south", "b_south"), size) == F.col("row"))
    return pairs.where(overlap & owner).select(F.col("a_id").alias(tile_id), F.col("b_id").alias(area_id))
