"""Local spatial autocorrelation: local Moran's I, Getis-Ord G, permutation tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, functions as F

from airq.operators.nearest import k_nearest, within_radius
from airq.operators.ordering import numbered
from airq.operators.ranks import benjamini_hochberg, exact_quantiles
from airq.session import materialize

MIN_CELLS = 30
PERMUTATIONS = 999
#: Shifts of an arithmetic permutation; side of the tiles in which permuted neighbours are summed.
HALF_ROUNDS = 6
TILE = 32
#: Fixed values of the hash: a prime and the factors of replicate, round, seed and number.
PRIME, REP_STEP, ROUND_STEP, SEED_STEP, OTHER_STEP = 2_147_483_647, 1_103_515_245, 104_729, 7_919, 40_503_767
#: Statistics that differ by less count as equal, because sums of doubles depend on their order.
SAME = 1e-9
#: Values at most that every task holds as one array; side of the blocks that a task works off; cells times replicates of a
#: task, about; numbers of one step, so that they stay in the processor's cache.
HELD, BLOCK, TASK_CELLS, STEP = 8_000_000, 128, 20_000_000, 65_536

QUEEN = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


def _spread(cells: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Every cell hands its columns to its eight neighbours (queen contiguity)."""
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in QUEEN])
    return cells.withColumn("_o", F.explode(offsets)).select(
        *by, (F.col("row") + F.col("_o.i")).alias("row"),
        (F.col("col") + F.col("_o.j")).alias("col"), *columns)


def neighbour_sums(cells: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Sum and number of the neighbours' values per cell of a regular grid.

    Contributions are summed before and after one shuffle; no cell is paired
    with a group of others.
    """
    by = by or []
    sums = _spread(cells.select(*by, "row", "col", value), by, [value]).groupBy(
        *by, "row", "col").agg(F.sum(value).alias("nbr_sum"), F.count(value).alias("nbr_count"))
    return cells.join(sums, [*by, "row", "col"], "left").fillna({"nbr_sum": 0.0, "nbr_count": 0})


def queen_threshold(cells: DataFrame, cell_id: str, dims: list[str], base: float) -> DataFrame:
    """1.5 times the median distance to the nearest other cell, one row."""
    # The search reads them several times.
    cells = materialize(cells.select(cell_id, *dims), "cells")
    nearest = k_nearest(cells, cells, dims, 1, cell_id, cell_id, base, exclude_same_id=True)
    return exact_quantiles(nearest, "distance", {"m": 0.5}).select(
        (F.col("m") * 1.5).alias("threshold"))


def neighbour_sums_within(cells: DataFrame, cell_id: str, dims: list[str], value: str,
                          radius: float) -> DataFrame:
    """Neighbour sums for scattered cells within a radius.

    Cells at one position are added up first, so a crowded position is one
    partner; a cell's own value is taken out again.
    """
    places = cells.groupBy(*dims).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    sums = within_radius(places.select(*dims), places, dims, radius).groupBy(*dims).agg(
        F.sum("s__s").alias("_s"), F.sum("s__n").alias("_n"))
    return cells.join(sums, dims, "left").withColumns({
        "nbr_sum": F.coalesce("_s", F.lit(0.0)) - F.col(value),
        "nbr_count": F.coalesce("_n", F.lit(1)) - 1}).drop("_s", "_n")


def _moments(cells: DataFrame, value: str, by: list[str]) -> DataFrame:
    return cells.groupBy(*by).agg(
        F.count(value).alias("_n"), F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))


def _with_moments(cells: DataFrame, value: str, by: list[str]) -> DataFrame:
    moments = _moments(cells, value, by)
    if by:
        return cells.join(moments, by)
    one = moments.select(F.struct("_n", "_mean", "_sd").alias("m")).scalar()
    return cells.withColumn("_m", one).select("*", "_m._n", "_m._mean", "_m._sd").drop("_m")


def local_moran(cells: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Add ``z``, ``moran_i`` and ``quadrant``; cells without neighbours get I = 0.

    Reads ``cells`` several times: pass a written table.
    """
    by = by or []
    scaled = _with_moments(cells.where(F.col(value).isNotNull()), value, by).withColumn(
        "z", (F.col(value) - F.col("_mean")) / (F.col("_sd") + F.lit(1e-10))).drop(
        "_n", "_mean", "_sd")
    lag = F.col("nbr_sum") / F.greatest(F.col("nbr_count"), F.lit(1))
    out = neighbour_sums(scaled, "z", by).withColumn(
        "moran_i", F.when(F.col("nbr_count") > 0, F.col("z") * lag).otherwise(0.0))
    high, lag_high = F.col("z") > 0, lag > 0
    return out.withColumn("quadrant", F.when(high & lag_high, "HH").when(high, "HL")
                          .when(lag_high, "LH").otherwise("LL"))


def getis_ord(cells: DataFrame, value: str, by: list[str] | None = None,
              include_self: bool = False) -> DataFrame:
    """Add ``gi``: standardised neighbour sum; a constant field gives 0.

    ``include_self`` adds the cell to its own neighbourhood (the starred form).
    Reads ``cells`` several times: pass a written table.
    """
    by = by or []
    out = neighbour_sums(_with_moments(cells.where(F.col(value).isNotNull()), value, by), value, by)
    w = F.col("nbr_count") + (1 if include_self else 0)
    total = F.col("nbr_sum") + (F.col(value) if include_self else F.lit(0.0))
    spread = F.col("_sd") * F.sqrt((F.col("_n") * w - w * w) / (F.col("_n") - 1))
    stat = F.when((F.col("_sd") < 1e-10) | (spread < 1e-10), 0.0).otherwise(
        (total - F.col("_mean") * w) / spread)
    return out.withColumn("gi", stat).drop("_n", "_mean", "_sd")


def permutation_p(cells: DataFrame, value: str, method: str, permutations: int = PERMUTATIONS,
                  seed: int = 42, chunk: int = 111) -> DataFrame:
    """Pseudo p-values from global permutations: (row, col, statistic, p_value).

    A permutation gives the value of one cell to another: the cells are numbered
    and the new number follows from the old one by arithmetic, so no replicate is
    sorted. Up to ``HELD`` cells each task holds all values and asks backwards which
    of them a cell has got, so that no replicate becomes rows. More cells, or cells
    that are not numbered one by one (repeated or NULL places), are worked off in chunks
    of replicates whose counts are stored, so that intermediate data is bounded by
    chunk * cells.
    """
    known = materialize(cells.where(F.col(value).isNotNull()).select(
        "row", "col", F.col(value).alias("x")), "tested-cells")
    stat = local_moran(known, "x") if method == "lisa" else getis_ord(known, "x")
    observed = stat.select("row", "col", F.col("moran_i" if method == "lisa" else "gi").alias("o"))
    cells_ = materialize(numbered(known, [F.col("row").asc(), F.col("col").asc()]).join(observed, ["row", "col"]), "numbered-cells")
    m = cells_.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.max("pos").alias("last")).first()
    exceed = None
    whole = 1 < m["n"] <= HELD and m["last"] == m["n"] - 1 and cells_.select("row", "col").distinct().count() == m["n"]
    if whole and permutations > 0:
        exceed = materialize(_held_exceedances(cells_, m, permutations, method, seed), "exceedances")
    for start in range(0, 0 if whole else permutations, chunk):
        reps = F.sequence(F.lit(start), F.lit(min(start + chunk, permutations) - 1))
        part = materialize(_exceedances(cells_, m, reps, method, seed), "exceedances")
        exceed = part if exceed is None else exceed.unionByName(part)
    counts = exceed.groupBy("row", "col").agg(F.sum("hits").alias("hits"))
    return cells_.join(counts, ["row", "col"], "left").select(
        "row", "col", F.col("o").alias("statistic"),
        ((F.coalesce("hits", F.lit(0)) + 1) / F.lit(permutations + 1)).alias("p_value"))


def permuted(df: DataFrame, n: int, seed: int, to: str = "to") -> DataFrame:
    """Add ``to``, the image of ``pos`` (0..n-1) under the random permutation number ``rep``.

    A Feistel network on pairs (left, right) of a field of a * b >= n numbers, in
    which left and right are shifted in turn by a hash of the other. What falls
    on one of the fewer than a numbers past the end is sent on until it does not.
    The hash is a square modulo a prime, so that SQL can deal the same cards.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def key(k: int | Column) -> Column:
        return (F.col("rep").cast("long") * REP_STEP + (k * ROUND_STEP + seed * SEED_STEP)) % PRIME

    def hashed(k: int | Column, other: Column) -> Column:
        return (key(k) + other.cast("long") * OTHER_STEP) % PRIME

    def shift(k: int | Column, one: Column, mixed: Column, size: Column) -> Column:
        return (one + (mixed * mixed + key(k)) % PRIME) % size

    def half_round(pair: Column, k: Column) -> Column:
        odd = k % 2 == 1
        one, other = F.when(odd, pair["l"]).otherwise(pair["r"]), F.when(odd, pair["r"]).otherwise(pair["l"])
        moved = shift(k, one, hashed(k, other), F.when(odd, F.lit(a)).otherwise(F.lit(b)))
        return F.struct(F.when(odd, moved).otherwise(pair["l"]).alias("l"), F.when(odd, pair["r"]).otherwise(moved).alias("r"))

    def again(x: Column) -> Column:
        """One more pass."""
        pair = F.struct(F.floor(x / b).alias("l"), (x % F.lit(b)).alias("r"))
        return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(HALF_ROUNDS - 1).cast("long")), pair, half_round, lambda p: p["l"] * b + p["r"])

    df = df.withColumns({"_l": F.floor(F.col("pos") / b), "_r": F.col("pos") % F.lit(b)})
    for k in range(HALF_ROUNDS):
        one, other = ("_l", "_r") if k % 2 else ("_r", "_l")
        df = df.withColumn("_m", hashed(k, F.col(other))).withColumn(one, shift(k, F.col(one), F.col("_m"), F.lit(a if k % 2 else b)))
    x = F.col("_l") * b + F.col("_r")
    on = F.aggregate(F.sequence(F.lit(1), F.lit(64)), x, lambda y, _: F.when(y < n, y).otherwise(again(y)))
    # Never NULL, and declared so: a join would push its test of NULL, with all rounds in it, below them.
    return df.withColumn(to, F.coalesce(F.when(x < n, x).otherwise(on), F.lit(-1))).drop("_l", "_r", "_m")


def shifts(n: int, permutations: int, seed: int) -> tuple[int, int, list[np.ndarray]]:
    """The field (a, b) of :func:`permuted` and, per half round, what each replicate adds: a table (replicate, other half)."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    reps, tables = np.arange(permutations, dtype=np.int64)[:, None], []
    for k in range(HALF_ROUNDS):
        one, other = (a, b) if k % 2 else (b, a)
        key = (reps * REP_STEP + (k * ROUND_STEP + seed * SEED_STEP)) % PRIME
        mixed = (key + np.arange(other, dtype=np.int64) * OTHER_STEP) % PRIME
        tables.append(((mixed * mixed + key) % PRIME % one).astype(np.int32))
    return a, b, tables


def _held_exceedances(known: DataFrame, moments: Row, permutations: int, method: str, seed: int) -> DataFrame:
    """As :func:`_exceedances` for all replicates, with all values as an array in every task.

    Cells are dealt to blocks with a border of one cell. A block takes the rounds of the
    permutation backwards, finds the value that each cell has got and sums those of its
    neighbours; the number of neighbours is the same in every replicate.
    """
    n, mean, sd = moments["n"], float(moments["mean"]), float(moments["sd"])
    values = known.select("pos", F.col("x").cast("double").alias("x")).toArrow()
    x = np.empty(n)
    x[values["pos"].to_numpy()] = values["x"].to_numpy()
    if method == "lisa":
        x = (x - mean) / (sd + 1e-10)
    held = known.sparkSession.sparkContext.broadcast((x, *shifts(n, permutations, seed)))
    half_rounds, step, same, queen = HALF_ROUNDS, STEP, SAME, QUEEN

    def task(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        x, a, b, tables = held.value
        row, col, pos = (cells[c].to_numpy(np.int64) for c in ("row", "col", "pos"))
        own = np.flatnonzero(cells["own"].to_numpy(bool))
        # A neighbour that is not there is the place behind the last cell, whose value is 0.
        low, width = (row.min(), col.min()), int(col.max() - col.min()) + 3
        at = np.full((int(row.max() - low[0]) + 3) * width, len(pos))
        spot = (row - low[0] + 1) * width + (col - low[1] + 1)
        at[spot] = np.arange(len(pos))
        around = [at[spot[own] + i * width + j] for i, j in queen]
        w = sum((q < len(pos)).astype(np.int64) for q in around)
        threshold = np.abs(cells["o"].to_numpy(np.float64)[own]) - same
        hits = np.zeros(len(own), np.int64)

        def before(y, first, second):
            """The numbers whose images are ``y``; ``first`` and ``second`` say where a replicate's tables begin."""
            left, right = np.divmod(y, b)
            for k in reversed(range(half_rounds)):
                if k % 2:
                    left = left - tables[k].reshape(-1)[right + second]
                    left += (left < 0) * a
                else:
                    right = right - tables[k].reshape(-1)[left + first]
                    right += (right < 0) * b
            return left * b + right

        with np.errstate(all="ignore"):
            spread = sd * np.sqrt((n * w - w * w) / (n - 1) + 1e-10)
            for start in range(0, tables[0].shape[0], size := max(1, step // len(pos))):
                reps = np.arange(start, min(start + size, tables[0].shape[0]))[:, None]
                source = before(np.broadcast_to(pos, (len(reps), len(pos))), reps * a, reps * b)
                while (past := source >= n).any():
                    rep = np.broadcast_to(reps, source.shape)[past]
                    source[past] = before(source[past], rep * a, rep * b)
                v = np.zeros((len(reps), len(pos) + 1))
                v[:, :-1] = x[source]
                total = sum(v[:, q] for q in around)
                if method == "lisa":
                    s = np.where(w > 0, v[:, own] * total / np.maximum(w, 1), 0.0)
                else:
                    s = (total - mean * w) / spread if sd >= 1e-10 else np.zeros(total.shape)
                # NaN is above all numbers, as in Spark.
                hits += ((np.abs(s) >= threshold) | np.isnan(s)).sum(axis=0)
        return pd.DataFrame({"row": row[own], "col": col[own], "hits": hits})

    block = lambda c: F.floor(c / BLOCK)
    around = lambda c: F.explode(F.array_distinct(F.array(block(F.col(c) - 1), block(F.col(c)), block(F.col(c) + 1))))
    placed = known.select("row", "col", "pos", "o").withColumn("_tr", around("row")).withColumn("_tc", around("col"))
    placed = placed.withColumn("own", (block(F.col("row")) == F.col("_tr")) & (block(F.col("col")) == F.col("_tc")))
    # The work is cells times replicates, so tasks are not dealt by bytes.
    tasks = int(min(8192, max(known.sparkSession.sparkContext.defaultParallelism, n * permutations / TASK_CELLS)))
    return placed.repartition(tasks, "_tr", "_tc").groupBy("_tr", "_tc").applyInPandas(task, "row long, col long, hits long")


def _exceedances(known: DataFrame, moments: Row, reps: Column, method: str, seed: int) -> DataFrame:
    """Per cell the number of replicates whose statistic is at least as extreme.

    Permuted cells are dealt to tiles with a border of one cell, so that
    neighbours are summed inside a task.
    """
    n, mean, sd = (F.lit(moments[k]) for k in ("n", "mean", "sd"))
    moved = permuted(known.select("pos", "x").withColumn("rep", F.explode(reps)), moments["n"], seed)
    places = known.select(F.col("pos").alias("to"), "row", "col", "o")
    z = (F.col("x") - mean) / (sd + F.lit(1e-10))
    # Replicates are exploded, so their size is far above Spark's guess; the cells are the side to hash, in slices.
    placed = moved.join(places.hint("shuffle_hash"), "to").select("rep", "row", "col", "o", (z if method == "lisa" else F.col("x")).alias("v"))
    tile = lambda c: F.floor(c / TILE)
    around = lambda c: F.explode(F.array_distinct(F.array(tile(F.col(c) - 1), tile(F.col(c)), tile(F.col(c) + 1))))
    keys = ["_tr", "_tc", "_b"]
    placed = placed.withColumn("_b", F.col("rep") % 8).withColumn("_tr", around("row")).withColumn("_tc", around("col"))
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in [(0, 0), *QUEEN]])
    given = placed.repartition(*keys).withColumn("_f", F.explode(offsets)).select(
        *keys, "rep", (F.col("row") + F.col("_f.i")).alias("row"), (F.col("col") + F.col("_f.j")).alias("col"),
        ((F.col("_f.i") == 0) & (F.col("_f.j") == 0)).alias("own"), "o", "v")
    given = given.where((tile(F.col("row")) == F.col("_tr")) & (tile(F.col("col")) == F.col("_tc")))
    summed = given.groupBy(*keys, "rep", "row", "col").agg(
        F.max(F.when(F.col("own"), F.col("v"))).alias("v"), F.max(F.when(F.col("own"), F.col("o"))).alias("o"),
        F.coalesce(F.sum(F.when(~F.col("own"), F.col("v"))), F.lit(0.0)).alias("nbr_sum"),
        F.count(F.when(~F.col("own"), 1)).alias("nbr_count")).where(F.col("v").isNotNull())
    w = F.col("nbr_count")
    if method == "lisa":
        stat = F.when(w > 0, F.col("v") * F.col("nbr_sum") / F.greatest(w, F.lit(1))).otherwise(0.0)
    else:
        spread = sd * F.sqrt((n * w - w * w) / (n - 1) + F.lit(1e-10))
        stat = (F.col("nbr_sum") - mean * w) / spread
    return summed.withColumn("s", stat).groupBy("row", "col").agg(
        F.count(F.when(F.abs("s") >= F.abs("o") - SAME, 1)).alias("hits"))


def analytic_p(statistics: DataFrame, statistic: str) -> DataFrame:
    """Two-sided normal p-value of a standardised statistic.

    The error function uses the published rational approximation with an
    absolute error below 1.5e-7.
    """
    a = F.abs(F.col(statistic)) / F.lit(2.0 ** 0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * a)
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (
        F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    return statistics.withColumn("p_value", poly * F.exp(-a * a))


def classified(tested: DataFrame, alpha: float) -> DataFrame:
    """Add ``significant`` and ``cluster_type`` after FDR control; reads ``tested`` twice."""
    tested = benjamini_hochberg(tested, "p_value", alpha)
    return tested.withColumn("cluster_type", (
        F.when(F.col("significant") & (F.col("statistic") > 0), "HOTSPOT")
        .when(F.col("significant") & (F.col("statistic") < 0), "COLDSPOT")
        .otherwise("NOT_SIGNIFICANT")))


def hotspot_analysis(cells: DataFrame, value: str, method: str = "lisa", alpha: float = 0.05,
                     permutations: int = PERMUTATIONS, seed: int = 42) -> DataFrame:
    """Classify cells as HOTSPOT / COLDSPOT / NOT_SIGNIFICANT after FDR control.

    Fewer than 30 cells are too few to test: no replicate is run, and statistic,
    p-value and class are NULL.
    """
    if method not in ("lisa", "getis_ord"):
        raise ValueError(f"unknown method {method!r}")
    known = cells.where(F.col(value).isNotNull())
    if known.limit(MIN_CELLS).count() < MIN_CELLS:
        none = F.lit(None)
        return known.select("row", "col", none.cast("double").alias("statistic"), none.cast("double").alias("p_value"),
                            F.lit(False).alias("significant"), none.cast("string").alias("cluster_type"))
    # Written, because the cut is found in one pass and applied in another.
    return classified(materialize(permutation_p(cells, value, method, permutations, seed), "tested"), alpha)


def hotspot_summary(classified: DataFrame) -> DataFrame:
    """Counts per class; fewer than 30 cells are reported as DEFERRED."""
    kind = F.col("cluster_type")
    return classified.agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count(F.when(kind == "HOTSPOT", 1)).alias("n_significant_hotspots"),
        F.count(F.when(kind == "COLDSPOT", 1)).alias("n_significant_coldspots"),
        F.avg("statistic").alias("mean_statistic"), F.max("statistic").alias("max_statistic"),
        F.min("statistic").alias("min_statistic"), F.avg("p_value").alias("mean_p_value"),
    ).withColumn("status", F.when(F.col("n_cells") < MIN_CELLS, "DEFERRED").otherwise("COMPUTED"))
