"""A training-data pipeline: toxic documents, repeated lines, near copies and benchmark documents go, the rest is packed."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from airq.llm.common import NO_ID, SPACES, remove, store, table
from airq.llm.decontaminate import contamination
from airq.llm.line_dedup import dedup_lines
from airq.llm.near_dedup import near_duplicates
from airq.llm.packing import pack
from airq.llm.toxicity import score_toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not among ``gone`` (doc_id), which may hold a null id."""
    gone, _ = store(gone.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("gone")), "gone")
    return docs.join(gone, F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == gone["gone"], "left_anti")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return _without(docs, scored.where("predicted = 1"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one line of each group of similar lines, the first one.

    Rows of a repeated doc_id whose lines go all get the text of the one document they count as. A document that is left
    without a word goes as a whole, since all that it said stands elsewhere; one that had none to begin with stays.
    """
    cleaned = dedup_lines(docs).where("n_removed > 0").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("of"), F.col("text").alias("cleaned"))
    cleaned, _ = store(cleaned, "cleaned")
    rows = docs.join(cleaned, F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == cleaned["of"], "left")
    changed = cleaned["of"].isNotNull()
    rows = rows.where(~changed | cleaned["cleaned"].rlike(f"[^{SPACES[1:-2]}]"))
    new = {"text": cleaned["cleaned"], "n_chars": F.char_length(cleaned["cleaned"]).cast("long")}
    return rows.select(*[F.when(changed, new[c]).otherwise(docs[c]).alias(c) if c in new else docs[c] for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return _without(docs, near_duplicates(docs).where("not kept"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return _without(docs, contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return pack(docs, f"{TOKENIZERS}/byte_bpe_50k.json")


#: SQL cannot say the stages that learn or pack.
ORACLE_SQL = None
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic), ("line_dedup", without_repeated_lines), ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again before the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, seen = store(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            remove(spark, before)
        before = seen["path"]
    # The last stage has read its documents when it returns.
    pieces = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, before)
    return pieces
