"""Leakage checks that stop a write when the table is not clean."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airq.functions.geo import SCOPES, in_bbox
from airq.operators.folds import split_overlap
from airq.operators.reports import duplicate_keys
from airq.schemas import FEATURES, TARGET

# Marker texts of test data and of features derived from the target.
SYNTHETIC_MARKERS = ["synthetic", "synth_", "sample_", "_test", "test_data"]
TARGET_TOKENS = ["pm25", "target", "aqi", "concentration"]


def synthetic_marker_scan(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n_rows) of identifiers that look like test data."""
    pattern = "|".join(SYNTHETIC_MARKERS)
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                      for c in columns])
    return (df.select(F.explode(pairs).alias("p"))
            .where(F.lower(F.col("p.v")).rlike(pattern))
            .groupBy(F.col("p.c").alias("column"), F.col("p.v").alias("value"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


def scope_contamination(df: DataFrame, scope: str, small_scope: str = "delhi",
                        origin_scope: str | None = None) -> DataFrame:
    """Rows of a broad-scope table inside a small scope's box, one number.

    With ``origin_scope`` naming a column, rows that are known to come from the
    broad scope itself do not count.
    """
    inside = in_bbox(F.col("longitude"), F.col("latitude"), SCOPES[small_scope])
    if scope == small_scope:
        inside = F.lit(False)
    elif origin_scope:
        inside = inside & (F.col(origin_scope) == small_scope)
    return df.agg(F.count(F.when(inside, 1)).alias("rows_inside"))


def leaked_features(features: list[str] | None = None) -> list[str]:
    """Feature names that give away the target."""
    return [f for f in (features or FEATURES) if any(t in f.lower() for t in TARGET_TOKENS)]


def copies_of_target(df: DataFrame, features: list[str], target: str = TARGET) -> DataFrame:
    """Number of features that equal the target wherever both are present, one number."""
    t = F.col(f"`{target}`")
    held = [f for f in features if f in df.columns and f != target]
    if not held:
        return df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("n"))
    values = [F.col(f"`{f}`").cast("double") for f in held]
    row = df.agg(*[F.struct(F.count(F.when(v.isNotNull() & t.isNotNull(), 1)).alias("n"),
                            F.count(F.when(v == t, 1)).alias("same")).alias(f"c{i}") for i, v in enumerate(values)])
    copied = [F.when((F.col(f"c{i}.n") > 0) & (F.col(f"c{i}.n") == F.col(f"c{i}.same")), 1).otherwise(0) for i in range(len(held))]
    return row.select(sum(copied, F.lit(0)).cast("bigint").alias("n"))


def leakage_suite(df: DataFrame, scope: str = "global", features: list[str] | None = None,
                  origin_scope: str | None = None, splits: DataFrame | None = None,
                  group: str = "station_id") -> DataFrame:
    """(check, violations, status) of all checks.

    ``splits`` (fold, group, split) lets the group check run; without it that
    check counts nothing and is N/A. A row has information from the future when the
    composite it uses starts after its date; a row without a date cannot be shown not to.
    """
    leaked = len(leaked_features(features))
    marks = synthetic_marker_scan(df, ["station_id", "country", "city"]).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"))
    overlap = F.lit(None).cast("bigint") if splits is None else split_overlap(splits, group).agg(
        F.count(F.lit(1)).alias("n")).scalar()
    late = F.col("date").isNull()
    if "NDVI_source_date" in df.columns:
        late = late | F.coalesce(F.col("NDVI_source_date") > F.col("date"), F.lit(False))
    if "NDVI_offset_days" in df.columns:
        late = late | F.coalesce(F.col("NDVI_offset_days") < 0, F.lit(False))
    row = df.agg(F.count(F.when(late, 1)).alias("bad_dates")).withColumns({
        "dups": duplicate_keys(df, ["station_id", "date"]).scalar(),
        "marks": marks.scalar(), "overlap": overlap,
        "copies": copies_of_target(df, features or FEATURES).scalar(),
        "inside": scope_contamination(df, scope, origin_scope=origin_scope).scalar()})

    def check(name, violations, status):
        return F.struct(F.lit(name).alias("check"), violations.cast("bigint").alias("violations"),
                        status.alias("status"))

    def fails(v):
        return F.when(v > 0, "FAIL").otherwise("PASS")

    items = F.array(
        check("target_leakage", F.lit(leaked), F.lit("FAIL" if leaked else "PASS")),
        check("duplicate_station_date", F.col("dups"), fails(F.col("dups"))),
        check("future_information", F.col("bad_dates"), fails(F.col("bad_dates"))),
        check("same_group_in_train_and_test", F.col("overlap"),
              F.when(F.col("overlap").isNull(), "N/A").otherwise(fails(F.col("overlap")))),
        check("features_from_target", F.col("copies"), fails(F.col("copies"))),
        check("synthetic_contamination", F.col("marks"),
              F.when(F.col("marks") > 0, "PRESENT").otherwise("NONE")),
        check("scope_contamination", F.col("inside"),
              F.lit("N/A") if scope == "delhi" else fails(F.col("inside"))))
    return row.select(F.explode(items).alias("r")).select("r.*")


def require_clean(suite: DataFrame) -> None:
    """Raise when a check failed. Call before any write of the table."""
    bad = [r["check"] for r in suite.where(F.col("status").isin("FAIL", "PRESENT")).collect()]
    if bad:
        raise ValueError(f"leakage checks failed: {', '.join(sorted(bad))}")


def require_model_inputs(df: DataFrame, features: list[str], target: str, group: str) -> None:
    """Raise unless the columns exist and the rows can be modelled."""
    absent = [c for c in [*features, target, group, "date"] if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    row = model_input_violations(df, features, target, group).first()
    problems = [name for name in ("missing_target", "non_finite_features", "duplicate_keys")
                if row[name]]
    if row["groups"] < 2:
        problems.append("fewer than two groups")
    if problems:
        raise ValueError(f"model inputs are not valid: {problems}")


def model_input_violations(df: DataFrame, features: list[str], target: str, group: str) -> DataFrame:
    """Violation counts in one row."""
    finite = F.lit(True)
    for f in features:
        c = F.col(f"`{f}`").cast("double")
        finite = finite & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return df.agg(
        F.count(F.when(F.col(f"`{target}`").isNull(), 1)).alias("missing_target"),
        F.count(F.when(~finite, 1)).alias("non_finite_features"),
        F.countDistinct(group).alias("groups"),
    ).withColumn("duplicate_keys", duplicate_keys(df, [group, "date"]).scalar())
