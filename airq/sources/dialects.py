"""Station files of mixed encodings, separators and headers, each read by its own dialect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from airq.session import materialize
from airq.sources.readers import STATION_ALIASES, coerce_station_types, rename_resolved

#: Separators that are tried, in this order.
SEPARATORS = [",", ";", "\t", "|"]
#: Files whose dialects are alike are read together; more kinds than this are an error of the source.
MOST_KINDS = 1_000


def _count(text: Column, sep: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sep), F.lit("")))


def file_dialects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, encoding, sep, header) of every file, in one pass over all lines.

    A file is UTF-8 if all its lines are, else ISO-8859-1; its header is the line at
    its beginning, and its separator the one that stands there most often, the first
    in the list on a tie. Files are cut as Spark likes: lines are judged where they
    lie, and only one row per file and task is shuffled.
    """
    paths = [path] if isinstance(path, str) else path
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    place = F.struct("block", "at")
    found = lines.groupBy("file").agg(F.min_by("value", place).alias("header"), F.min(F.is_valid_utf8("value")).alias("valid"))
    header = F.regexp_replace("header", "^\\x{FEFF}", "")
    sep = F.array_max(F.array(*[F.struct(_count(F.col("header"), s).alias("n"), F.lit(-i).alias("rank"), F.lit(s).alias("sep")) for i, s in enumerate(SEPARATORS)]))["sep"]
    return found.withColumn("header", header).select("file", F.when(F.col("valid"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"), sep.alias("sep"), "header")


def read_mixed_station_csv(spark: SparkSession, path: str | list[str], timezone: str = "Asia/Kolkata",
                           configured: dict[str, str] | None = None) -> DataFrame:
    """Station observations of files that need not be alike, with the columns of the station table and ``file``.

    Files of one dialect are read together. A column that a file lacks is NULL. Files
    without a line give no rows.
    """
    kinds = materialize(file_dialects(spark, path), "dialects")
    # ISO-8859-1 headers are decoded as such; only their plain letters matter for names.
    groups = kinds.groupBy("encoding", "sep", "header").agg(F.collect_list("file").alias("files")).limit(MOST_KINDS + 1).collect()
    if len(groups) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of files")
    out = None
    for kind in sorted(groups, key=lambda k: (k["encoding"], k["sep"], k["header"] or "")):
        raw = (spark.read.option("header", True).option("inferSchema", False).option("encoding", kind["encoding"])
               .option("sep", kind["sep"]).csv(sorted(kind["files"])))
        named = rename_resolved(raw.select("*", F.col("_metadata.file_name").alias("file")), STATION_ALIASES, configured)
        part = coerce_station_types(named, timezone)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no file has a line")
    return out
