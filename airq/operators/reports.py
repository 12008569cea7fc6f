"""Table reports. Each report is one aggregate pass, never one job per metric."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from airq.functions.geo import region_of_country
from airq.operators.ranks import average_ranks, exact_quantiles
from airq.schemas import FEATURES, TARGET

# Surface of the earth and thresholds of the reports.
EARTH_AREA_MILLION_KM2 = 510.1
MIN_ROWS_FOR_MODELING = 20
MIN_STATIONS_LOSO, MIN_COUNTRIES_LOCO = 5, 2


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def unpivot_numeric(df: DataFrame, columns: list[str], name: str = "feature",
                    value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """(keep..., feature, value) rows of several numeric columns."""
    keep = keep or []
    safe = df.select(*[_c(k) for k in keep],
                     *[_c(c).cast("double").alias(f"_u{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("n"), F.col(f"_u{i}").alias("v"))
                      for i, c in enumerate(columns)])
    return safe.select(*[_c(k) for k in keep], F.explode(pairs).alias("p")).select(
        *[_c(k) for k in keep], F.col("p.n").alias(name), F.col("p.v").alias(value))


def _wide_to_rows(row: DataFrame, names: list[str], measures: list[str], key: str) -> DataFrame:
    """Turn one wide row of ``<i>_<measure>`` columns into a row per name."""
    items = F.array(*[F.struct(F.lit(n).alias(key), *[F.col(f"{i}_{m}").alias(m) for m in measures])
                      for i, n in enumerate(names)])
    return row.select(F.explode(items).alias("r")).select("r.*")


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null count, null count and missing share per column."""
    row = df.agg(*[x for i, c in enumerate(columns) for x in (
        F.count(_c(c)).alias(f"{i}_n_non_null"),
        (F.count(F.lit(1)) - F.count(_c(c))).alias(f"{i}_n_null"),
        F.coalesce((F.count(F.lit(1)) - F.count(_c(c))) / F.count(F.lit(1)), F.lit(1.0))
        .alias(f"{i}_pct_missing"))])
    return _wide_to_rows(row, columns, ["n_non_null", "n_null", "pct_missing"], "column")


def feature_coverage(df: DataFrame, features: list[str]) -> DataFrame:
    """Valid, missing, share and distinct count per feature.

    Distinct values are first reduced to (feature, value) pairs, which keeps
    the exact count distributed over values.
    """
    long = unpivot_numeric(df, features).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"))
    filled = F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)
    return long.groupBy("feature").agg(
        F.sum(filled).alias("valid_count"), (F.sum("n") - F.sum(filled)).alias("missing_count"),
        (F.lit(100.0) * (F.sum("n") - F.sum(filled)) / F.sum("n")).alias("missing_percentage"),
        F.count("value").alias("unique_count"))


def top_missing(coverage: DataFrame, n: int = 3) -> DataFrame:
    """The features with the largest missing share (name breaks ties)."""
    return coverage.select("feature", "missing_percentage").orderBy(
        F.desc("missing_percentage"), "feature").limit(n)


def _country() -> Column:
    return F.coalesce(F.col("country"), F.lit("(unknown)"))


def coverage_by_country(df: DataFrame) -> DataFrame:
    return df.groupBy(_country().alias("country")).agg(
        F.count("station_id").alias("n_rows"), F.countDistinct("station_id").alias("n_stations"),
        F.count(F.when(F.col("complete_case"), 1)).alias("n_complete_rows"),
        F.avg(F.col("complete_case").cast("double")).alias("pct_complete"))


def top_countries(by_country: DataFrame, n: int = 15) -> DataFrame:
    """The countries with most rows (name breaks ties)."""
    return by_country.orderBy(F.desc("n_rows"), "country").limit(n)


def coverage_by_month(df: DataFrame) -> DataFrame:
    month = F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("NaT")).alias("month")
    return df.groupBy(month).agg(
        F.count("station_id").alias("n_rows"), F.countDistinct("station_id").alias("n_stations"),
        F.count(F.when(F.col("complete_case"), 1)).alias("n_complete_rows"))


def geographic_bias(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Features whose missing share differs between countries."""
    features = features or FEATURES
    rates = df.groupBy(_country().alias("_country")).agg(*[
        F.avg(_c(f).isNull().cast("double")).alias(f"r{i}") for i, f in enumerate(features)])
    row = rates.agg(*[x for i, _ in enumerate(features) for x in (
        F.min(f"r{i}").alias(f"{i}_min_pct_missing"), F.max(f"r{i}").alias(f"{i}_max_pct_missing"))])
    return _wide_to_rows(row, features, ["min_pct_missing", "max_pct_missing"], "feature").where(
        F.col("max_pct_missing") > F.col("min_pct_missing"))


def duplicate_keys(df: DataFrame, keys: list[str], name: str = "duplicates") -> DataFrame:
    """Rows beyond the first per key, as one number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias(name))


def target_qc(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Missing, negative, zero and duplicate counts of the target."""
    t = _c(target)
    out = df.agg(
        F.count(F.lit(1)).alias("total_candidate_rows"),
        F.count(F.when(t.isNull(), 1)).alias("missing_target"),
        F.count(F.when(t < 0, 1)).alias("negative_target"),
        F.count(F.when(t == 0, 1)).alias("zero_target"),
        F.count(F.when(t.isNull() | (t < 0), 1)).alias("invalid_target_rows"))
    return out.withColumn("duplicate_station_date",
                          duplicate_keys(df, ["station_id", "date"]).scalar())


def table_qc(df: DataFrame, target: str = TARGET, max_value: float = 1000.0) -> DataFrame:
    """Rows, duplicate keys, invalid dates, negative and implausible targets."""
    t = _c(target)
    out = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("date").isNull(), 1)).alias("invalid_dates"),
        F.count(F.when(t < 0, 1)).alias("negative_target"),
        F.count(F.when(t > max_value, 1)).alias("above_max_target"))
    return out.withColumn("duplicate_station_dates",
                          duplicate_keys(df, ["station_id", "date"]).scalar())


def target_report(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Distribution of the target and whether there is enough to model."""
    t = _c(target)
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count(t).alias("n_target_valid"),
        F.count(F.when(F.col("complete_case"), 1)).alias("n_complete_case_rows"),
        F.avg(F.col("complete_case").cast("double")).alias("complete_case_ratio"),
        F.avg(t).alias("mean"), F.min(t).alias("min"), F.max(t).alias("max"),
        F.stddev_samp(t).alias("std"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"), F.countDistinct("date").alias("n_days"))
    quartiles = exact_quantiles(df, target, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    q = quartiles.select(F.struct("p25", "median", "p75").alias("q")).scalar()
    return row.withColumn("_q", q).select("*", "_q.p25", "_q.median", "_q.p75").drop("_q").withColumn(
        "completeness_flag", F.when(F.col("n_complete_case_rows") >= MIN_ROWS_FOR_MODELING,
                                    "sufficient").otherwise("insufficient"))


def target_by(df: DataFrame, key: str, target: str = TARGET) -> DataFrame:
    """Count and mean of valid targets per country or station."""
    group = _country() if key == "country" else F.col(key)
    t = _c(target)
    return df.where(t.isNotNull()).groupBy(group.alias(key)).agg(
        F.count(t).alias("count"), F.avg(t).alias("mean"))


def representativeness(df: DataFrame) -> DataFrame:
    """Stations, countries, days and stations per million square kilometres."""
    return df.agg(
        F.countDistinct("station_id").alias("stations"),
        F.countDistinct("country").alias("countries"), F.countDistinct("date").alias("n_days"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    ).withColumn("spatial_density", F.when(
        (F.col("stations") > 0) & (F.col("countries") > 0),
        F.col("stations") / F.lit(EARTH_AREA_MILLION_KM2)))


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation, one aggregate for all pairs."""
    pairs = list(itertools.combinations(columns, 2))
    row = df.agg(*[x for i, (a, b) in enumerate(pairs) for x in (
        F.corr(_c(a), _c(b)).alias(f"{i}_pearson"),
        F.count(F.when(_c(a).isNotNull() & _c(b).isNotNull(), 1)).alias(f"{i}_n"))])
    items = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                               F.col(f"{i}_pearson").alias("pearson"), F.col(f"{i}_n").alias("n"))
                      for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(items).alias("r")).select("r.*")


def correlation_pairs(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """Pearson and Spearman on rows that are complete in all columns.

    Spearman is Pearson on average ranks. Ranks of all columns are found in one
    pass over (column, value), then brought back to the rows. ``key`` names the
    row. Pairs that are undefined in both measures are left out.
    """
    from airq.functions.status import all_present
    complete = df.where(all_present(columns))
    long = unpivot_numeric(complete, columns, keep=key)
    ranks = average_ranks(long, "value", by=["feature"])
    # Ranks of many equal values are small as a file and large in memory, so they are never broadcast.
    ranked = long.join(ranks.hint("merge"), ["feature", "value"]).groupBy(*key).agg(*[
        F.max(F.when(F.col("feature") == c, F.col("avg_rank"))).alias(f"rank{i}")
        for i, c in enumerate(columns)])
    spearman = ranked.agg(*[F.corr(f"rank{i}", f"rank{j}").alias(f"s_{i}_{j}")
                            for i, j in itertools.combinations(range(len(columns)), 2)])
    pearson = complete.agg(F.count(F.lit(1)).alias("n"), *[
        F.corr(_c(columns[i]), _c(columns[j])).alias(f"p_{i}_{j}")
        for i, j in itertools.combinations(range(len(columns)), 2)])
    both = pearson.withColumn("_s", spearman.select(F.struct("*").alias("s")).scalar())
    items = F.array(*[F.struct(
        F.lit(columns[i]).alias("feature_a"), F.lit(columns[j]).alias("feature_b"),
        F.col(f"p_{i}_{j}").alias("pearson"), F.col(f"_s.s_{i}_{j}").alias("spearman"),
        F.col("n").alias("n")) for i, j in itertools.combinations(range(len(columns)), 2)])
    return both.select(F.explode(items).alias("r")).select("r.*").where(
        (F.col("n") >= 2) & (F.col("pearson").isNotNull() | F.col("spearman").isNotNull()))


def spatial_group_labels(df: DataFrame) -> DataFrame:
    """Region and fold labels of every row."""
    country = _country()
    return df.withColumns({
        "country": country, "region": region_of_country(F.col("country")),
        "fold_station": F.concat(F.lit("station_"), F.col("station_id")),
        "fold_country": F.concat(F.lit("country_"), country)})


def group_statistics(labelled: DataFrame) -> DataFrame:
    """Distinct stations, countries and regions overall, per region, per country."""
    reduced = labelled.select("station_id", "country", "region").distinct().withColumns(
        {"_country": F.col("country"), "_region": F.col("region")})
    sets = reduced.groupingSets([[], ["region"], ["country"]], "region", "country")
    return sets.agg(
        F.grouping_id().alias("_g"), F.countDistinct("station_id").alias("stations"),
        F.countDistinct("_country").alias("countries"), F.countDistinct("_region").alias("regions"),
    ).select(F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "region")
             .otherwise("country").alias("level"),
             F.coalesce("region", "country", F.lit("all")).alias("name"), "stations",
             "countries", "regions")


def loso_loco_status(df: DataFrame) -> DataFrame:
    """Whether leaving out a station or a country is defensible."""
    row = df.agg(F.countDistinct("station_id").alias("s"), F.countDistinct("country").alias("c"),
                 F.count(F.when(F.col("complete_case"), 1)).alias("k"))

    def verdict(n: Column, minimum: int) -> Column:
        return F.when((n >= minimum) & (F.col("k") >= n * 2), "READY").otherwise("INSUFFICIENT_DATA")

    items = F.array(
        F.struct(F.lit("Leave-One-Station-Out").alias("method"), F.col("s").alias("n_groups"),
                 F.lit(MIN_STATIONS_LOSO).cast("bigint").alias("min_groups"), F.col("k").alias("n_complete_case_rows"),
                 verdict(F.col("s"), MIN_STATIONS_LOSO).alias("status")),
        F.struct(F.lit("Leave-One-Country-Out").alias("method"), F.col("c").alias("n_groups"),
                 F.lit(MIN_COUNTRIES_LOCO).cast("bigint").alias("min_groups"), F.col("k").alias("n_complete_case_rows"),
                 verdict(F.col("c"), MIN_COUNTRIES_LOCO).alias("status")))
    return row.select(F.explode(items).alias("r")).select("r.*")


def alignment_coverage(features: DataFrame, sources: dict[str, str]) -> DataFrame:
    """Share of cell-days each source covers; ``sources`` maps name to column."""
    names = list(sources)
    row = features.agg(*[x for i, n in enumerate(names) for x in (
        F.count(_c(sources[n])).alias(f"{i}_present"), F.count(F.lit(1)).alias(f"{i}_total"),
        (F.lit(100.0) * F.count(_c(sources[n])) / F.greatest(F.count(F.lit(1)), F.lit(1)))
        .alias(f"{i}_percent_available"))])
    return _wide_to_rows(row, names, ["present", "total", "percent_available"], "source")


def violation_report(checks: dict[str, Column], df: DataFrame) -> DataFrame:
    """(check, violations, passed) for conditions that must hold in every row."""
    names = list(checks)
    row = df.agg(*[F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias(f"{i}_violations")
                   for i, ok in enumerate(checks.values())])
    return _wide_to_rows(row, names, ["violations"], "check").withColumn(
        "passed", F.col("violations") == 0)


def alignment_checks(features: DataFrame, children: DataFrame, stations: DataFrame, parents: DataFrame) -> DataFrame:
    """Uniqueness, parents, no target among the features and no look-ahead, as violation counts.

    ``parents`` (row, col) are the cells that exist; a child whose parent is not among them is a violation. Cells of
    both grids, days of a cell and days of a station must each be there once.
    """
    def once(df: DataFrame, keys: list[str], check: str) -> DataFrame:
        return duplicate_keys(df, keys).select(F.lit(check).alias("check"), F.col("duplicates").alias("violations"))

    unique = [once(parents, ["row", "col"], "parent_ids_unique"), once(children, ["row", "col"], "child_ids_unique"),
              once(features, ["grid_id", "date"], "no_duplicate_grid_date"),
              once(stations, ["station_id", "date"], "no_duplicate_station_date")]
    # A matter of the schema: one row, whatever the number of cells.
    named = features.sparkSession.range(1).select(
        F.lit("target_not_in_features").alias("check"), F.lit(features.columns.count(TARGET)).cast("bigint").alias("violations"))
    there = parents.select(F.col("row").alias("parent_row"), F.col("col").alias("parent_col"))
    orphans = children.join(there, ["parent_row", "parent_col"], "left_anti").agg(
        F.lit("all_target_cells_have_parent").alias("check"), F.count(F.lit(1)).alias("violations"))
    future = violation_report({
        "no_future_ndvi": F.coalesce(F.col("ndvi_offset_days") >= 0, F.lit(True)),
        "no_future_viirs": F.coalesce(F.col("viirs_offset_days") >= 0, F.lit(True)),
        "missing_is_null_not_nodata": F.coalesce(F.col("value") != -9999.0, F.lit(True)),
    }, features)
    return (reduce(DataFrame.unionByName, [*unique, named, orphans]).withColumn("passed", F.col("violations") == 0)
            .unionByName(future))


def inference_report(predictions: DataFrame, value: str = "predicted_PM25") -> DataFrame:
    """Totals, coverage and range of a prediction table."""
    return predictions.agg(
        F.count(F.lit(1)).alias("total_cells"), F.count(value).alias("valid_cells"),
        F.count(F.when(F.col(value).isNull(), 1)).alias("nodata_cells"),
        (F.lit(100.0) * F.count(value) / F.count(F.lit(1))).alias("coverage_percent"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))


def prediction_status_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("prediction_status").agg(F.count(F.lit(1)).alias("n_cells"))


def require_predictions(predictions: DataFrame, value: str = "predicted_PM25") -> None:
    """Refuse a prediction table in which no cell has a value."""
    if predictions.where(F.col(value).isNotNull()).isEmpty():
        raise ValueError("no cell has a prediction; nothing may be published")


def final_checks(cells: DataFrame, zones: DataFrame, n_rows: int, n_cols: int,
                 concentration: DataFrame | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Consistency of the published products, as violation counts.

    ``cells`` has row, col, pm25, aqi and aqi_category; ``zones`` has the
    bounding rows and columns. The area has ``n_rows`` by ``n_cols`` cells.
    ``concentration`` (row, col) is the product that the index was made from:
    a cell that only one of both has is a violation. ``hot`` (row, col) are the
    cells that were marked: each must have a concentration in ``cells``.
    """
    has_value = F.col("pm25").isNotNull()
    in_area = (F.col("row") >= 0) & (F.col("row") < n_rows) & (F.col("col") >= 0) & (F.col("col") < n_cols)
    cell = violation_report({
        "every_index_has_a_concentration": F.col("aqi").isNull() | has_value,
        "every_category_has_an_index": F.col("aqi_category").isNull() | F.col("aqi").isNotNull(),
        "index_in_range": F.col("aqi").isNull() | F.col("aqi").between(0, 500),
        "cells_in_area": in_area}, cells)
    zone = violation_report({"zones_in_area": (
        (F.col("min_row") >= 0) & (F.col("max_row") < n_rows)
        & (F.col("min_col") >= 0) & (F.col("max_col") < n_cols))}, zones)
    out = cell.unionByName(zone)

    def counted(check: str, violations: DataFrame) -> DataFrame:
        return violations.agg(F.lit(check).alias("check"), F.count(F.lit(1)).alias("violations")).withColumn(
            "passed", F.col("violations") == 0)

    if concentration is not None:
        sides = cells.select("row", "col", F.lit(1).alias("_side")).unionByName(
            concentration.select("row", "col", F.lit(2).alias("_side")))
        lone = sides.groupBy("row", "col").agg(F.bit_or("_side").alias("_sides")).where("_sides <> 3")
        out = out.unionByName(counted("one_grid_for_both_products", lone))
    if hot is not None:
        valued = cells.where(has_value).select("row", "col")
        out = out.unionByName(counted("hot_cells_have_a_concentration", hot.join(valued, ["row", "col"], "left_anti")))
    return out
