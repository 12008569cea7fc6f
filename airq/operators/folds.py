"""Spatial folds, overlap checks and fold metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from airq.session import materialize

MIN_ROWS_FOR_R2 = 3
MAX_STATIONS_FOR_LOGO = 8
FOLD_LIMIT = 5
VALIDATED_R2 = 0.5


def _deal(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, int, int, list[int]]]:
    """Largest group first, each into the lightest fold so far, for (size, number of groups).

    Returns (size, first rank, end rank, cycle): among the groups of a size, rank
    r of a stretch goes to ``cycle[(r - first) % len(cycle)]``. While groups of
    one size are dealt, the folds that lie less than a size above the lightest
    take turns, and other folds join one by one, so a size has at most as many
    stretches as there are folds.
    """
    loads = [0] * folds
    out = []
    for size, groups in sorted(sizes, reverse=True):
        begin = 0
        while begin < groups:
            order = sorted(range(folds), key=lambda f: (loads[f], f))
            low = loads[order[0]]
            turn = [f for f in order if loads[f] < low + size or f == order[0]]
            later = [loads[f] - low for f in order if f not in turn]
            rounds = max(1, min(later) // size) if later else groups
            end = min(groups, begin + rounds * len(turn))
            out.append((size, begin, end, turn))
            for i, f in enumerate(turn):
                loads[f] += size * ((end - begin - i + len(turn) - 1) // len(turn))
            begin = end
    return out


def _ranked(sizes: DataFrame, group: str) -> DataFrame:
    """Groups with ``rank`` over all of them by name, nulls first, and ``among`` those of their size.

    Range partitions are numbered on their own and moved by what lies before them.
    """
    def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        keys = [F.col(c).asc_nulls_first() for c in [*by, group]]
        dealt = materialize(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "groups")
        place = Window.partitionBy("_part", *by).orderBy(F.col(group).asc_nulls_first())
        held = dealt.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_c"))
        before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        start = held.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
        return dealt.withColumn("_at", F.row_number().over(place)).join(start, ["_part", *by]).withColumn(
            name, (F.col("_at") + F.col("_before") - 1).cast("bigint")).drop("_part", "_at", "_before")

    return numbered(numbered(sizes, [], "rank"), ["n"], "among")


def choose_strategy(n_groups: int, strategy: str = "auto") -> str:
    if strategy != "auto":
        return strategy
    return "leave_one_group_out" if n_groups <= MAX_STATIONS_FOR_LOGO else "group_kfold"


def assign_folds(df: DataFrame, group: str, strategy: str = "auto", k: int = FOLD_LIMIT) -> DataFrame:
    """Add the test ``fold`` of each row; one rule at every size.

    ``leave_one_group_out`` numbers the groups by name. ``group_kfold`` deals
    them, largest first and equal ones by name, into the lightest of k folds.
    Only the distinct sizes and their numbers reach the driver, no list of
    groups. Rows without a group are a group of their own, first by name.
    ``auto`` leaves each group out where there are eight or fewer.
    """
    sizes = materialize(_ranked(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group), "fold-groups")
    histogram = [(r["n"], r["c"]) for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()]
    groups = sum(c for _, c in histogram)
    if choose_strategy(groups, strategy) == "leave_one_group_out":
        folds = sizes.select(F.col(group).alias("_g"), F.col("rank").cast("int").alias("fold"))
    else:
        rows = _deal(histogram, max(1, min(k, groups)))
        table = df.sparkSession.createDataFrame(rows, "n bigint, _first bigint, _end bigint, _cycle array<int>")
        turn = ((F.col("among") - F.col("_first")) % F.size("_cycle")).cast("int")
        folds = sizes.join(table, "n").where((F.col("among") >= F.col("_first")) & (F.col("among") < F.col("_end"))).select(
            F.col(group).alias("_g"), F.get("_cycle", turn).alias("fold"))
    return df.join(folds, df[group].eqNullSafe(F.col("_g"))).drop("_g")


def fold_index(df: DataFrame, group: str) -> DataFrame:
    """Leave-one-group-out number of every group: its position in sorted order."""
    return assign_folds(df.select(group).distinct(), group, "leave_one_group_out")


def split_rows(folded: DataFrame, n_folds: int) -> DataFrame:
    """Every row in every fold, marked train or test."""
    each = folded.withColumnRenamed("fold", "_own").withColumn(
        "fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    return each.withColumn("split", F.when(F.col("_own") == F.col("fold"), "test")
                           .otherwise("train")).drop("_own")


def split_overlap(splits: DataFrame, group: str) -> DataFrame:
    """(fold, group) pairs present in both train and test of a fold; must be empty."""
    return splits.groupBy("fold", group).agg(
        F.countDistinct("split").alias("_n")).where(F.col("_n") > 1).drop("_n")


def split_sizes(folded: DataFrame, group: str) -> DataFrame:
    """(fold, split, rows, groups, shared) of every side of every fold, without writing rows once a fold.

    ``shared`` is the number of groups on both sides of the fold: those that have
    rows in this fold and in another. All follows from one count per (group,
    fold); the train side is what the test side leaves of the totals. Rows
    without a group are a group of their own. Sides without rows are left out.
    """
    homes = materialize(folded.groupBy(group, "fold").agg(F.count(F.lit(1)).alias("_n")), "homes")
    # A group has at most one row per fold here.
    spread = homes.withColumn("_homes", F.count(F.lit(1)).over(Window.partitionBy(group)))
    tests = spread.groupBy("fold").agg(
        F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_groups"),
        F.count(F.when(F.col("_homes") > 1, 1)).alias("shared"))
    whole = homes.groupBy(group).agg(F.sum("_n").alias("_n")).agg(
        F.struct(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("groups")).alias("t"))
    sides = tests.withColumn("_t", whole.scalar()).withColumn("_side", F.explode(F.array(
        F.struct(F.lit("test").alias("split"), F.col("_rows").alias("rows"), F.col("_groups").alias("groups")),
        F.struct(F.lit("train").alias("split"), (F.col("_t.rows") - F.col("_rows")).alias("rows"),
                 (F.col("_t.groups") - F.col("_groups") + F.col("shared")).alias("groups")))))
    return sides.select("fold", "_side.*", "shared").where("rows > 0")


def fold_metrics(predictions: DataFrame, keys: list[str], observed: str = "observed_PM25",
                 predicted: str = "predicted_PM25") -> DataFrame:
    """MAE, RMSE and R2 per key; R2 is NULL below three rows or without variance."""
    y, p = F.col(observed), F.col(predicted)
    e = y - p
    out = predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("_sse"), (F.var_pop(y) * F.count(y)).alias("_sst"))
    r2 = F.when((F.col("n") >= MIN_ROWS_FOR_R2) & (F.col("_sst") > 0),
                F.lit(1.0) - F.col("_sse") / F.col("_sst"))
    return out.withColumn("r2", r2).drop("_sse", "_sst")


def aggregate_metrics(predictions: DataFrame, model: str = "model", fold: str = "fold") -> DataFrame:
    """Mean over folds and pooled out-of-fold metrics per model."""
    per_fold = fold_metrics(predictions, [model, fold]).groupBy(model).agg(
        F.avg("mae").alias("mean_fold_mae"), F.avg("rmse").alias("mean_fold_rmse"),
        F.avg("r2").alias("mean_fold_r2"), F.count("r2").alias("valid_r2_folds"),
        F.count(F.when(F.col("r2").isNull(), 1)).alias("r2_undefined_folds"))
    pooled = fold_metrics(predictions, [model]).select(
        model, F.col("mae").alias("pooled_oof_mae"), F.col("rmse").alias("pooled_oof_rmse"),
        F.col("r2").alias("pooled_oof_r2"))
    return per_fold.join(pooled, model).withColumn(
        "validated", F.coalesce(F.col("pooled_oof_r2") >= VALIDATED_R2, F.lit(False)))
