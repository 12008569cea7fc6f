"""Local autocorrelation of cells that are given by latitude and longitude only.

The neighbours are found once and stored as a graph, one row per directed pair.
Permuted values are pushed along it, so a replicate costs one join by cell
number and sums that are reduced before the shuffle; no cell meets a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, functions as F

from airq.operators.autocorr import (MIN_CELLS, PERMUTATIONS, SAME, classified, permuted,
                                     queen_threshold)
from airq.operators.nearest import within_radius
from airq.operators.ordering import numbered
from airq.session import discard, materialize

METHODS = ("lisa", "getis_ord")


def neighbour_graph(cells: DataFrame, base: float) -> DataFrame:
    """(pos, other) for every two cells that touch, as a stored table.

    ``cells`` has ``pos``, ``latitude`` and ``longitude``. Cells touch that are no
    farther apart than 1.5 times the median distance to the nearest other cell, which
    takes in the eight neighbours on a regular grid. Cells at one place touch too.
    """
    dims = ["longitude", "latitude"]
    reach = queen_threshold(cells, "pos", dims, base).first()["threshold"]
    if reach is None:
        return materialize(cells.select("pos", F.col("pos").alias("other")).limit(0), "graph")
    places = cells.select("pos", *dims)
    if reach <= 0:
        # The median cell shares its place with another, so only those touch.
        pairs = places.join(places.withColumnRenamed("pos", "other"), dims).select("pos", "other")
    else:
        pairs = within_radius(places, places, dims, reach).select("pos", F.col("s_pos").alias("other"))
    return materialize(pairs.where("pos <> other"), "graph")


def _statistic(method: str, m: Row, v: Column, total: Column, w: Column, observed: bool) -> Column:
    """The local statistic of a value, its neighbours' sum and number."""
    n, mean, sd = (F.lit(m[k]).cast("double") for k in ("n", "mean", "sd"))
    if method == "lisa":
        scale = sd + F.lit(1e-10)
        return F.when(w > 0, (v - mean) / scale * ((total - w * mean) / scale) / F.greatest(w, F.lit(1))).otherwise(0.0)
    inside = (n * w - w * w) / (n - 1)
    spread = sd * F.sqrt(inside if observed else inside + F.lit(1e-10))
    flat = (spread < 1e-10) if observed else (sd < 1e-10)
    return F.when(flat, 0.0).otherwise((total - mean * w) / spread)


def scattered_permutation_p(cells: DataFrame, graph: DataFrame, method: str, permutations: int = PERMUTATIONS,
                            seed: int = 42, chunk: int = 111) -> DataFrame:
    """(pos, statistic, p_value) of numbered cells (``pos``, ``x``) under global permutations.

    Replicates are worked off in chunks whose counts are stored, so intermediate
    data is bounded by chunk * pairs of neighbours.
    """
    m = cells.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd")).first()
    # Each cell hands its value to itself and to its neighbours.
    given = graph.select(F.col("other").alias("to"), "pos", F.lit(False).alias("own")).unionByName(
        cells.select(F.col("pos").alias("to"), "pos", F.lit(True).alias("own")))
    sums = [F.max(F.when(F.col("own"), F.col("x"))).alias("v"), F.coalesce(F.sum(F.when(~F.col("own"), F.col("x"))), F.lit(0.0)).alias("total"),
            F.count(F.when(~F.col("own"), 1)).alias("w")]
    first = given.join(cells.select(F.col("pos").alias("to"), "x"), "to").groupBy("pos").agg(*sums)
    observed = materialize(first.select("pos", _statistic(method, m, F.col("v"), F.col("total"), F.col("w"), True).alias("o")), "observed")
    # The pairs carry what the comparison needs, so no replicate is joined again.
    given = materialize(given.join(observed, "pos"), "pairs")
    parts = []
    for start in range(0, permutations, chunk):
        reps = F.sequence(F.lit(start), F.lit(min(start + chunk, permutations) - 1))
        moved = permuted(cells.select("pos", "x").withColumn("rep", F.explode(reps)), m["n"], seed).select("rep", "to", "x")
        # Replicates are exploded and would be taken for small; neither side is broadcast.
        each = moved.join(given.hint("merge"), "to").groupBy("pos", "rep").agg(*sums, F.max("o").alias("o"))
        s = _statistic(method, m, F.col("v"), F.col("total"), F.col("w"), False)
        parts.append(materialize(each.groupBy("pos").agg(F.count(F.when(F.abs(s) >= F.abs("o") - SAME, 1)).alias("hits")), "exceedances"))
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    out = materialize(observed.join(counts.groupBy("pos").agg(F.sum("hits").alias("hits")), "pos", "left").select(
        "pos", F.col("o").alias("statistic"), ((F.coalesce("hits", F.lit(0)) + 1) / F.lit(permutations + 1)).alias("p_value")), "tested")
    for part in [*parts, given, observed]:
        discard(part)
    return out


def scattered_hotspots(cells: DataFrame, value: str = "PM2.5", methods: tuple[str, ...] = METHODS, alpha: float = 0.05,
                       permutations: int = PERMUTATIONS, seed: int = 42, base: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Classes of cells given by ``latitude``, ``longitude`` and a value, and a report with a row per method.

    The classes have (method, latitude, longitude, value, statistic, p_value,
    significant, cluster_type). A missing column or fewer than 30 rows without a NULL
    is reported as DEFERRED with the reason; no replicate is run then and there are
    no classes. Rows are numbered by position and value, so a result does not
    depend on how they arrive.
    """
    for method in methods:
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}")
    spark = cells.sparkSession
    missing = [c for c in ("latitude", "longitude", value) if c not in cells.columns]
    nothing = spark.createDataFrame([], "method string, latitude double, longitude double, value double, statistic double, "
                                        "p_value double, significant boolean, cluster_type string")
    if missing:
        return nothing, _deferred(spark, methods, "missing_columns: " + ", ".join(missing), 0)
    known = cells.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in (("latitude", "latitude"), ("longitude", "longitude"), (value, "x"))])
    known = materialize(numbered(known.dropna(), [F.col(c).asc() for c in ("latitude", "longitude", "x")]), "cells")
    n = known.count()
    if n < MIN_CELLS:
        return nothing, _deferred(spark, methods, f"insufficient_cells: {n} < {MIN_CELLS}", n)
    graph = neighbour_graph(known, base)
    results, reports = [], []
    for method in methods:
        tested = classified(scattered_permutation_p(known, graph, method, permutations, seed), alpha)
        found = materialize(known.join(tested, "pos").select(F.lit(method).alias("method"), "latitude", "longitude", F.col("x").alias("value"),
                                                            "statistic", "p_value", "significant", "cluster_type"), "classes")
        results.append(found)
        reports.append(_report(found))
    discard(graph)
    classes, report = results[0], reports[0]
    for one, other in zip(results[1:], reports[1:]):
        classes, report = classes.unionByName(one), report.unionByName(other)
    return classes, report


_COUNTS = {"n_significant_hotspots": "HOTSPOT", "n_significant_coldspots": "COLDSPOT", "n_not_significant": "NOT_SIGNIFICANT"}


def _report(classes: DataFrame) -> DataFrame:
    kind = F.col("cluster_type")
    return classes.groupBy("method").agg(
        F.lit("COMPUTED").alias("status"), F.lit("").alias("reason"), F.count(F.lit(1)).alias("n_cells"),
        *[F.count(F.when(kind == k, 1)).alias(c) for c, k in _COUNTS.items()],
        F.avg("statistic").alias("mean_statistic"), F.max("statistic").alias("max_statistic"),
        F.min("statistic").alias("min_statistic"), F.avg("p_value").alias("mean_p_value"))


def _deferred(spark, methods: tuple[str, ...], reason: str, n: int) -> DataFrame:
    none = F.lit(None).cast("double")
    one = spark.range(1).select(F.explode(F.array(*map(F.lit, methods))).alias("method"))
    return one.select("method", F.lit("DEFERRED").alias("status"), F.lit(reason).alias("reason"), F.lit(n).cast("long").alias("n_cells"),
                      *[F.lit(0).cast("long").alias(c) for c in _COUNTS],
                      *[none.alias(c) for c in ("mean_statistic", "max_statistic", "min_statistic", "mean_p_value")])
