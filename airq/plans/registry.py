"""Registration of queries and composition of their independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, parts: tuple[str, ...] | list[str] = ()):
    """Register a query and, where SQL can say it, the SQL for the same result."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            from airq.plans.sql_parts import with_parts
            ORACLES[name] = with_parts(parts, sql)
        return fn
    return register


def r6(column: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison: sums of doubles depend on their order."""
    return F.round(column, digits)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


def day(column: Column | str, name: str = "date") -> Column:
    """A date as text, which both engines print alike."""
    return F.date_format(column, "yyyy-MM-dd").alias(name)


def stamp(column: Column | str, name: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name)
