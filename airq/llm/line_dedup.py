"""Fuzzy duplicate lines over a whole corpus: one line of each component of similar lines stays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from airq.llm.common import BASE, BYTE_CODES, keyed, mix, only, rolling, scratch, slices, store, text_bytes, unkeyed
from airq.llm.linking import Banding, Sets, components_of, signatures

#: Misses a pair of similarity 0.8 with a chance of 0.002.
BANDING = Banding(bands=12, rows=4, entries=48)


#: White space at the ends of a line does not count.
BLANK = " \t\n\x0b\x0c\r"


def char_shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size`` consecutive characters of each text (repeats included), flat, and the texts' offsets.

    A shorter text is one shingle.
    """
    data, offsets = text_bytes(column)
    inner = np.append((data & 0xC0) == 0x80, [False] * 4)
    starts = np.flatnonzero(~inner[:-4])
    codes = BYTE_CODES[data]
    # A character's code folds its up to four bytes.
    char, more = codes[starts], np.searchsorted(starts, np.flatnonzero(data >= 0xC0))
    for j in (1, 2, 3):
        more = more[inner[starts[more] + j]]
        char[more] = char[more] * np.uint64(BASE) + codes[starts[more] + j]
    first = np.searchsorted(starts, offsets)
    value = rolling(char, size)
    counts = np.diff(first)
    whole = np.maximum(counts - size + 1, 0)
    before = np.cumsum(whole) - whole
    at = np.arange(whole.sum()) + np.repeat(first[:-1] - before, whole)
    values = mix(value[at])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        length = counts[short]
        nth = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        weights = char[np.repeat(first[short], length) + nth] * (nth + 1).astype(np.uint64)
        values = np.insert(values, before[short], mix(np.add.reduceat(weights, np.cumsum(length) - length), 9))
    return values, np.concatenate([[0], np.cumsum(np.where(counts >= size, whole, counts > 0))])


def _describe(size: int):
    """Lines and signatures; the signature only where a task meets the line first."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in slices(batches, "line"):
            ids = batch.column("id").to_pylist()
            new = [i for i, x in enumerate(ids) if x not in met and not met.add(x)]
            values, runs = char_shingles(batch.column("line").take(pa.array(new, pa.int32())), size)
            at = np.full(len(ids), -1)
            at[new] = np.arange(len(new))
            sig = signatures(values, runs, BANDING.entries).take(pa.array(at, mask=at < 0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("at"), batch.column("id"), sig],
                                             ["doc_id", "at", "id", "sig"])
    return task


def _decoder(size: int) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """The sets of lines, which travel as their bytes."""
    def decode(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        values, runs = char_shingles(pa.array(lines, pa.binary()).cast(pa.string()), size)
        for a, b in zip(runs[:-1].tolist(), runs[1:].tolist()):
            values[a:b].sort()
        new = np.append(True, values[1:] != values[:-1])
        new[runs[:-1]] = True
        return values[new], np.concatenate([[0], np.cumsum(new)])[runs]
    return decode


def _lines(text: str = "text") -> Column:
    return F.split(text, "\n", -1)


def dedup_lines(docs: DataFrame, size: int = 8, percent: int = 80, render: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """(doc_id, text, n_lines, n_removed), one row per doc_id: the text without lines that a kept line stands for.

    Lines are what ``\\n`` separates, compared without ASCII white space at their ends; blank lines are always kept. Lines
    whose sets of ``size``-character shingles have 100 * intersection >= percent * union are linked (a shorter line is
    one shingle, so it equals only itself). Of each component the line that comes first, by smallest doc_id and then
    position, stays; all others go. Equal lines are one node of the graph, named by a 64-bit hash. ``render`` is applied
    to the text where it is made, so that a digest can be had without moving texts.

    Null and empty texts have one blank line and keep their text. Repeated doc_ids count as one document (see
    :func:`airq.llm.common.one_per_id`); a null doc_id comes first. Further columns are not read.
    """
    docs = keyed(docs)
    with scratch(docs.sparkSession) as kept:
        gone, seen = store(_repeated(docs, size, percent), "lines-gone")
        kept.append(seen["path"])
    left = F.filter(F.transform(_lines(), lambda x, i: F.when(F.array_contains("gone", i), None).otherwise(x)), lambda x: x.isNotNull())
    cut = only(docs, gone.select("doc_id")).join(gone, "doc_id").select(
        F.col("doc_id").alias("of"), render(F.array_join(left, "\n")).alias("cut"), F.size("gone").cast("long").alias("n"))
    rows = docs.select("doc_id", render(F.col("text")).alias("text"), F.coalesce(F.size(_lines()), F.lit(1)).cast("long").alias("n_lines"))
    return rows.join(cut, F.col("doc_id") == F.col("of"), "left").select(
        unkeyed(), F.when(F.col("n").isNull(), F.col("text")).otherwise(F.col("cut")).alias("text"), "n_lines",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_removed"))


def _repeated(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, gone): the numbers of the lines that another one stands for."""
    lines = docs.select("doc_id", F.posexplode(_lines()).alias("at", "raw")).select(
        "doc_id", "at", F.btrim("raw", F.lit(BLANK)).alias("line")).where("line <> ''")
    places, _ = store(lines.select("doc_id", "at", F.xxhash64("line").alias("id"), "line").mapInArrow(
        _describe(size), "doc_id long, at int, id long, sig binary"), "lines")
    nodes, _ = store(places.groupBy("id").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")), "line-nodes")

    def read(ids: DataFrame) -> DataFrame:
        """Lines as bytes, from the documents in which they stand first."""
        at = only(nodes, ids, "id").select("first.doc_id", F.struct("id", "first.at").alias("w"))
        wanted, _ = store(at.groupBy("doc_id").agg(F.collect_list("w").alias("wanted")), "wanted")
        texts = only(docs, wanted.select("doc_id")).join(wanted, "doc_id").withColumn("parts", _lines())
        found = texts.select(F.explode(F.transform("wanted", lambda w: F.struct(w["id"].alias("id"), F.get("parts", w["at"]).alias("raw")))).alias("x"))
        return found.select("x.id", F.encode(F.btrim("x.raw", F.lit(BLANK)), "UTF-8").alias("members"))

    items = places.where("sig is not null").select("id", F.lit(None).cast("bigint").alias("size"), "sig")
    found = components_of(items, BANDING, Sets(read, _decoder(size)), percent)
    # Only lines of a component, and equal lines, can go.
    equal = nodes.where("n > 1").join(found, "id", "left_anti").withColumn("component", F.col("id"))
    named = only(nodes, found.select("id"), "id").join(found, "id").unionByName(equal)
    keep = named.groupBy("component").agg(F.min("first").alias("keep"))
    named, _ = store(named.join(keep, "component").select("id", "keep"), "line-keepers")
    return only(places.select("doc_id", "at", "id"), named.select("id"), "id").join(named, "id").where(
        F.struct("doc_id", "at") != F.col("keep")).groupBy("doc_id").agg(F.collect_list("at").alias("gone"))
