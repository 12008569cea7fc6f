"""Exact repeated spans of words by a compacted De Bruijn graph.

Every window of ``span`` words is an edge from its first span - 1 words to its last. Only edges that can repeat are
shuffled: a window's minimizer, the least hash of the short seeds in it, is the same wherever the window stands, so a
window whose minimizer occurs once is unique. Repeated edges learn the coordinate of their first occurrence, and edges
that follow each other both where they stand and at their source, without a branch in between, are compacted to one
path (a span with one source). A document's words under its paths go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window, functions as F

from airq.llm.common import SPACES, grams, keyed, only, scratch, slices, store, text_bytes, unkeyed, words

#: Words of a seed.
SEED = 6
#: Edges whose minimizer occurs more often take the way that splits hot keys.
HOT = 20_000


def _edges(column: pa.Array, span: int) -> tuple[np.ndarray, ...]:
    """Of all windows: first word in the batch, first word in the text, text; their minimizers' words; all seeds; words."""
    data, offsets = text_bytes(column)
    hashes, _, first = words(data, offsets)
    _, inside = grams(hashes, first, span)
    at = np.flatnonzero(inside)
    owner = np.searchsorted(first, at, side="right") - 1
    seeds, _ = grams(hashes, first, min(SEED, span))
    least = sliding_window_view(seeds, span - min(SEED, span) + 1)[at].argmin(1) + at if len(at) else at
    return at, at - first[owner], owner, least, seeds, hashes, first


def _seeds(span: int):
    """Distinct minimizers of each document with their places."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, _, _, least, seeds, _, first = _edges(batch.column("text"), span)
            least = np.unique(least)
            owner = np.searchsorted(first, least, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner)), pa.array((least - first[owner]).astype(np.int32)),
                 pa.array(seeds[least].view(np.int64))], ["doc_id", "at", "seed"])
    return task


def _candidates(span: int, is_hot: bool):
    """The windows whose minimizer stands at one of the given places: hash, check value, coordinate."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            at, start, owner, least, _, hashes, first = _edges(batch.column("text"), span)
            places, hot = batch.column("places"), batch.column("hot")
            of = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(places).to_numpy(zero_copy_only=False))
            marks = np.zeros(len(hashes) + 1, np.int8)
            marks[first[of] + places.flatten().to_numpy(zero_copy_only=False)] = 1 + hot.flatten().to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(marks[least] == 1 + is_hot)
            value, _ = grams(hashes, first, span)
            check, _ = grams(hashes ^ (hashes >> np.uint64(17)), first, span)
            at = at[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[at].view(np.int64)), pa.array((check[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                 batch.column("doc_id").take(pa.array(owner[keep])), pa.array(start[keep].astype(np.int32))],
                ["edge", "part", "doc_id", "start"])
    return task


def _remove(span: int):
    """Texts without the words under the given paths, as digest and count."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            removed, kept_words = [], []
            for text, paths in zip(batch.column("text").to_pylist(), batch.column("paths").to_pylist()):
                parts = text.translate(_BLANK).split(" ")
                parts = [p for p in parts if p]
                cover = np.zeros(len(parts) + 1, np.int64)
                for path in paths:
                    cover[path["start"]] += 1
                    cover[path["start"] + path["edges"] + span - 1] -= 1
                under = np.cumsum(cover)[:-1] > 0
                removed.append(int(under.sum()))
                kept_words.append(" ".join([p for p, u in zip(parts, under.tolist()) if not u]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(removed, pa.int64()), pa.array(kept_words, pa.large_string()).cast(pa.string())],
                ["doc_id", "n_gone", "left"])
    return task


_BLANK = {c: " " for c in range(9, 14)}


def repeated_paths(docs: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """Paths (doc_id, start, edges, source_doc, source_start) of documents ``docs`` (doc_id, text), and exact copies.

    A path of n edges covers n + span - 1 words from ``start``, all of them found earlier at its source. Documents
    that as a whole equal one of smaller id have no paths; the second table names them.
    """
    text = F.coalesce("text", F.lit(""))
    sums = docs.select("doc_id", F.md5(F.encode(text, "UTF-8")).alias("sum"))
    first = sums.groupBy("sum").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies, _ = store(sums.join(first, "sum").where("doc_id <> first").select("doc_id"), "copies")

    seeds = docs.mapInArrow(_seeds(span), "doc_id long, at int, seed long")
    often = seeds.groupBy("seed").count().where("count > 1").select("seed", (F.col("count") > HOT).alias("hot"))
    places = seeds.join(often, "seed").join(copies, "doc_id", "left_anti").groupBy("doc_id").agg(
        F.collect_list("at").alias("places"), F.collect_list("hot").alias("hot"))
    places, seen = store(places, "places", {"hot": F.max(F.exists("hot", lambda h: h))})

    def edges(hot: bool) -> DataFrame:
        of = places.where(F.exists("hot", lambda h: h == hot))
        texts = only(docs, of.select("doc_id")).join(of, "doc_id").select("doc_id", "text", "places", "hot")
        return texts.mapInArrow(_candidates(span, hot), "edge long, part int, doc_id long, start int")

    found = edges(False)
    ordered = Window.partitionBy("edge", "part").orderBy("doc_id", "start")
    source = found.withColumns({"source_doc": F.first("doc_id").over(ordered), "source_start": F.first("start").over(ordered)})
    if seen["hot"]:
        found, _ = store(edges(True), "hot-edges")
        least = found.groupBy("edge", "part").agg(F.min(F.struct("doc_id", "start")).alias("m"))
        source = source.unionByName(found.join(least, ["edge", "part"]).select(
            *found.columns, F.col("m.doc_id").alias("source_doc"), F.col("m.start").alias("source_start")))
    again = source.where("doc_id <> source_doc or start <> source_start")

    again = again.withColumn("shift", F.col("source_start") - F.col("start"))
    along = Window.partitionBy("doc_id", "source_doc", "shift").orderBy("start")
    path = again.withColumn("run", F.col("start") - F.row_number().over(along)).groupBy("doc_id", "source_doc", "shift", "run").agg(
        F.min("start").alias("start"), F.count(F.lit(1)).cast("int").alias("edges"))
    return store(path.select("doc_id", "start", "edges", "source_doc", (F.col("start") + F.col("shift")).alias("source_start")), "paths")[0], copies


def remove_repeats(docs: DataFrame, span: int = 20, render: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """(doc_id, n_words, n_removed, kept), one row per doc_id: the words no repeated window covers, joined by one space.

    Words are what ASCII white space separates, unchanged. A window is ``span`` consecutive words of one document; it
    repeats if the same words also start earlier, at a smaller doc_id or before it in the same document. Windows are
    judged on the input. A document that as a whole equals an earlier one loses all words if it has ``span`` or more.
    ``render`` is applied to the kept text where it is made, so that a digest can be had without moving texts.

    Null and empty texts have no words. Repeated doc_ids count as one document (see :func:`airq.llm.common.one_per_id`);
    a null doc_id comes first. Further columns are not read. Edges are told apart by 96 bits of hash.
    """
    docs = keyed(docs)
    with scratch(docs.sparkSession) as kept:
        paths, copies = repeated_paths(docs, span)
        grouped, seen = store(paths.groupBy("doc_id").agg(F.collect_list(F.struct("start", "edges")).alias("paths")), "grouped-paths")
        copies, also = store(copies, "copies")
        kept += [seen["path"], also["path"]]
    cut = only(docs, grouped.select("doc_id")).join(grouped, "doc_id").select("doc_id", "text", "paths").mapInArrow(
        _remove(span), "doc_id long, n_gone long, left string").select(F.col("doc_id").alias("of"), "n_gone", render(F.col("left")).alias("left"))
    whole = F.filter(F.split(F.coalesce("text", F.lit("")), SPACES), lambda w: w != "")
    rows = docs.select("doc_id", F.size(whole).cast("long").alias("n_words"), render(F.array_join(whole, " ")).alias("all"))
    joined = rows.join(copies.withColumnRenamed("doc_id", "copy"), F.col("doc_id") == F.col("copy"), "left").join(
        cut, F.col("doc_id") == F.col("of"), "left")
    repeats = F.col("copy").isNotNull() & (F.col("n_words") >= span)
    return joined.select(
        unkeyed(), "n_words", F.when(repeats, F.col("n_words")).otherwise(F.coalesce("n_gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(repeats, render(F.lit(""))).when(F.col("of").isNotNull(), F.col("left")).otherwise(F.col("all")).alias("kept"))
