"""The queries of this subpackage and, where SQL can say it, the SQL with the same result."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from airq.llm import sql
from airq.llm.chat_format import Template, format_chats, read_back
from airq.llm.common import store, table
from airq.llm.decontaminate import contamination
from airq.llm.fertility import fertility_rules
from airq.llm.line_dedup import dedup_lines
from airq.llm.mixing import mix_sources
from airq.llm.near_dedup import near_duplicates
from airq.llm.ordinal_quality import grade_quality
from airq.llm.packing import pack
from airq.llm.prefix_trie import prefix_trie
from airq.llm.substring_dedup import remove_repeats
from airq.llm.toxicity import score_toxicity
from airq.llm.warc_zstd import read_archives, resolved, train_dictionary, write_archives
from airq.llm.whitening import whiten

#: Where the public vocabularies lie, on the driver and on every executor.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def _vocabulary(name: str) -> str:
    """Path of a public vocabulary file, by the installed package unless a folder is named."""
    if "PUBLIC_TOKENIZERS" not in os.environ:
        try:
            import public_tokenizers
            return str(public_tokenizers.path(name))
        except ImportError:
            pass
    return f"{TOKENIZERS}/{name}"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    formatted = format_chats(chats.unionByName(control))
    back = read_back(formatted.select("conv_id", "segments", "formatted", "valid"), Template(), "valid", "formatted")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"), "valid")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), render=lambda text: F.sha2(F.coalesce(text, F.lit("")), 256)).select(
        "doc_id", "n_lines", "n_removed", F.col("text").alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), 20, lambda text: F.sha2(text, 256)).withColumnRenamed("kept", "kept_sha256")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    # Three grades: poor, good but toxic, good.
    grade = F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))
    return grade_quality(table(spark, sf_dir, "documents"), labels.select("doc_id", grade.alias("grade")), top=2)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives, _ = store(write_archives(pages, train_dictionary(pages)), "archives")
    return resolved(read_archives(archives)).where("problem is null").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility_rules(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=8)
    each = whitened.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_line_dedup, op3_decontaminate, op4_substring_dedup, op5_packing,
                                 op6_quality_classifier, op7_toxicity, op8_near_dedup, op9_warc, op10_quality_rules,
                                 op11_mixing, op12_whitening, op13_prefix_trie)}
ORACLES = {"op1_chat_format": sql.CHAT_FORMAT, "op3_decontaminate": sql.DECONTAMINATE, "op4_substring_dedup": sql.SUBSTRING_DEDUP,
           "op8_near_dedup": sql.NEAR_DEDUP, "op9_warc": sql.WARC, "op11_mixing": sql.MIXING,
           "op13_prefix_trie": sql.PREFIX_TRIE}
