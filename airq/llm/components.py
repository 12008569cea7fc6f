"""Distributed union-find: connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airq.llm.common import remove, store


def _step(links: DataFrame, large: bool) -> DataFrame:
    """One contraction. Large: greater neighbours of a node go to its minimum. Small: smaller ones and the node do."""
    if large:
        ends = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = ends.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    moved = moved.where("u <> v")
    return moved if large else moved.distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node that has a link; component is the smallest id reachable.

    ``links`` has two bigint columns ``u`` and ``v``; direction, repeats and self-links do not matter; rows with a null
    end are no links. Every round ends in a stored table, and the one before it is deleted. Rounds grow with the
    logarithm of the number of nodes; the loop ends when a round changes nothing.
    """
    spark = links.sparkSession
    held = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    watch = {"n": F.count(F.lit(1)), "x": F.bit_xor(F.xxhash64("u", "v"))}
    held, seen = store(held, "links", watch)
    while seen["n"]:
        now, after = store(_step(_step(held, True), False), "links", watch)
        remove(spark, seen["path"])
        done = (after["n"], after["x"]) == (seen["n"], seen["x"])
        held, seen = now, after
        if done:
            break
    return held.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        held.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
