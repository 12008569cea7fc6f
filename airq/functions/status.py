"""Small status ladders: freshness, confidence, predictions, availability."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# How long an acquisition stays fresh, in seconds per source.
FRESHNESS_WINDOW_S = {
    "pm25": 7 * 86400, "aod": 30 * 86400, "weather": 90 * 86400, "ndvi": 32 * 86400,
    "dem": 365 * 86400, "osm": 30 * 86400, "viirs": 30 * 86400,
}
DEFAULT_WINDOW_S = 30 * 86400

# Severity order of source states.
STATUS_SEVERITY = {"AVAILABLE": 0, "PARTIAL": 1, "STALE": 2, "UNAVAILABLE": 3, "FAILED": 4}


def freshness_window(source: Column) -> Column:
    pairs = [F.lit(x) for pair in FRESHNESS_WINDOW_S.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), source), F.lit(DEFAULT_WINDOW_S))


def freshness(last_fetch: Column, window_s: Column, as_of: Column) -> dict[str, Column]:
    """Age in seconds, freshness flag and reason of an ISO timestamp string.

    ``as_of`` is an argument so that a result can be reproduced.
    """
    fetched = F.try_to_timestamp(last_fetch)
    age = (F.unix_micros(as_of) - F.unix_micros(fetched)) / F.lit(1e6)
    fresh = F.coalesce(age <= window_s, F.lit(False))
    reason = (
        F.when(last_fetch.isNull(), F.lit("never_fetched"))
        .when(fetched.isNull(), F.lit("unparseable_timestamp"))
        .when(~fresh, F.concat(F.lit("age_"), age.cast("bigint").cast("string"),
                               F.lit("s_exceeds_window_"), window_s.cast("string"), F.lit("s")))
    )
    return {"age_s": F.round(age, 1), "fresh": fresh, "stale_reason": reason}


def confidence(status: Column, fresh: Column, has_checksums: Column) -> dict[str, Column]:
    """NONE / LOW / MEDIUM / HIGH with the reason."""
    down = status.isin("UNAVAILABLE", "FAILED")
    level = (
        F.when(down, "NONE").when(status == "STALE", "LOW").when(status == "PARTIAL", "MEDIUM")
        .when(~fresh, "MEDIUM").when(~has_checksums, "LOW").otherwise("HIGH"))
    reason = (
        F.when(down, F.lower(status)).when(status == "STALE", "data_stale")
        .when(status == "PARTIAL", "partial_coverage")
        .when(~fresh, "data_available_but_stale").when(~has_checksums, "no_checksums")
        .otherwise("fresh_with_checksums"))
    return {"confidence": level, "confidence_reason": reason}


def ready_for_training(status: Column, level: Column, minimum: str = "MEDIUM") -> Column:
    """Source usable for training; the least acceptable confidence is a parameter."""
    ladder = ["NONE", "LOW", "MEDIUM", "HIGH"]
    return (status == "AVAILABLE") & level.isin(*ladder[ladder.index(minimum):])


def all_present(columns: list[str]) -> Column:
    out = F.lit(True)
    for name in columns:
        out = out & F.col(f"`{name}`").isNotNull()
    return out


def count_present(columns: list[str]) -> Column:
    out = F.lit(0)
    for name in columns:
        out = out + F.col(f"`{name}`").isNotNull().cast("int")
    return out


def prediction_status_coarse(features: list[str]) -> Column:
    return F.when(all_present(features), "valid").otherwise("missing_feature")


def prediction_status_fine(parent: Column, residual: Column, model_used: bool) -> Column:
    if not model_used:
        return F.when(parent.isNull(), "missing_parent").otherwise("baseline_prototype")
    usable = residual.isNotNull() & ~F.isnan(residual)
    return (F.when(parent.isNull(), "missing_parent")
            .when(~usable, "missing_feature").otherwise("downscaled_residual"))


def clip_negative(prediction: Column) -> Column:
    """Floor at zero; missing stays missing."""
    return F.when(prediction.isNotNull(), F.greatest(prediction, F.lit(0.0)))
