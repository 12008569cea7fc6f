"""MinHash near-duplicate documents with sequential Bayesian verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from airq.llm.common import (distinct_sets, grams, mix, keyed, only, reduce_runs, scratch, slices, store, text_bytes, unkeyed,
                             words)
from airq.llm.linking import Banding, Sets, components_of, decoded, signatures

SHAPE = "doc_id long, size long, k1 long, k2 long, sig binary"
#: Misses a pair of similarity 0.8 with a chance of 5e-5.
BANDING = Banding(bands=25, rows=5, entries=128)


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text, flat, and the offsets of the texts' runs.

    A-Z is lower-cased. A text of fewer words than a shingle has is one shingle; one without words has none.
    """
    data, offsets = text_bytes(column)
    hashes, _, first = words(data, offsets, lower=True)
    counts = np.diff(first)
    values, inside = grams(hashes, first, shingle)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(inside)
    values, owner = values[at], owner[at]
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    whole = np.zeros(len(short), np.uint64)
    for k, i in enumerate(short):
        for h in hashes[first[i]:first[i + 1]]:
            whole[k] = mix(whole[k:k + 1] ^ h)[0]
    order = np.argsort(np.concatenate([owner, short]), kind="stable")
    return distinct_sets(np.concatenate([values, mix(whole, 3)])[order], np.concatenate([owner, short])[order], len(counts))


def _describe(shingle: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, runs = shingle_sets(batch.column("text"), shingle)
            sig = signatures(values, runs, BANDING.entries)
            sums = [pa.array(reduce_runs(np.add, mix(values, s), runs, 0).view(np.int64)) for s in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(runs)), *sums, sig],
                ["doc_id", "size", "k1", "k2", "sig"])
    return task


def _sets(docs: DataFrame, shingle: int):
    """Full sets of some documents as ascending hashes."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, runs = shingle_sets(batch.column("text"), shingle)
            members = [values[a:b].tobytes() for a, b in zip(runs[:-1], runs[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(members, pa.binary())], ["id", "members"])

    def read(ids: DataFrame) -> DataFrame:
        return only(docs.withColumnRenamed("doc_id", "id"), ids, "id").mapInArrow(task, "id long, members binary")

    return Sets(read, decoded)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = 1e-4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per doc_id.

    Words are what white space of ASCII separates, A-Z lower-cased; a document's set holds its distinct shingles of
    ``shingle`` words. Documents with 100 * intersection >= percent * union are linked, component_id is the smallest
    doc_id reachable, and that document is kept. Equal sets are one class first and only its smallest id is compared.

    Nulls and empty texts have no shingles, link with nothing and are kept. Repeated doc_ids count as one document (see
    :func:`airq.llm.common.one_per_id`), a null doc_id as one too; it comes first, and the component_id of what is linked
    with it is null. Further columns are not read.
    """
    docs = keyed(docs)
    with scratch(docs.sparkSession) as kept:
        result, seen = store(_linked(docs, shingle, percent, miss), "near-duplicates")
        kept.append(seen["path"])
    return result


def _linked(docs: DataFrame, shingle: int, percent: int, miss: float) -> DataFrame:
    described, _ = store(docs.mapInArrow(_describe(shingle), SHAPE), "sets")
    keys = ["size", "k1", "k2"]
    member = described.where("size > 0").select("doc_id", *keys)
    classes, _ = store(member.join(member.groupBy(*keys).agg(F.min("doc_id").alias("first")), keys).select("doc_id", "first"), "classes")
    items, _ = store(described.join(classes.where("doc_id = first").select("doc_id"), "doc_id", "left_semi")
                     .select(F.col("doc_id").alias("id"), "size", "sig"), "items")
    found = components_of(items, BANDING, _sets(docs, shingle), percent, miss)
    named = classes.join(found.withColumnRenamed("id", "first"), "first", "left").select(
        F.col("doc_id").alias("id"), F.coalesce("component", "first").alias("component"))
    rows = described.select("doc_id", "size").join(named, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept")) \
        .select(unkeyed(), "n_shingles", unkeyed("component_id"), "kept")
