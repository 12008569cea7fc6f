"""Keeping one row per key without moving the other rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def keep_first(df: DataFrame, keys: list[str], order: str,
               count_as: str | None = None) -> DataFrame:
    """First row per key by ``order``; NULL keys compare equal.

    An aggregate, not a window: each task reduces its own rows before the
    shuffle, so a key that holds a large share of all rows costs one row per
    task. ``count_as`` names a column for the number of rows per key.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(order)).alias("_row")
    extra = [F.count(F.lit(1)).alias(count_as)] if count_as else []
    grouped = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(first, *extra)
    out = [F.col(f"`{c}`") if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns]
    return grouped.select(*out, *([F.col(count_as)] if count_as else []))


def latest(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Values of the row with the greatest ``order`` per key."""
    picked = F.max_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.col(order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(
        *keys, *[F.col(f"_row.`{c}`").alias(c) for c in columns])
