"""What several operators share: stored tables, one row per document id, word and shingle hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from airq.session import new_shared_path

#: The word class ``[^\x20\x09-\x0D]+`` as a Java and Python pattern of what lies between words.
SPACES = "[ \\t-\\r]+"
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch at most: whole documents of ten thousand rows are some 50 MB in the executor, outside its heap, and again in Python.
BATCH_ROWS = 2_000


# -- tables ------------------------------------------------------------------------------------------------------------

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths of the tables that are open in a :func:`scratch` scope, in order.
_STORED: list[str] = []


def store(df: DataFrame, name: str, watch: dict[str, Column] | None = None) -> tuple[DataFrame, dict]:
    """Write a table to the shared folder and read it back; also the values of ``watch`` over its rows.

    The copy cuts the lineage, survives lost executors and has a known size, so the optimizer broadcasts it in a later
    join exactly where it is small.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, name)
    seen = Observation()
    if watch:
        df = df.observe(seen, *[c.alias(k) for k, c in watch.items()])
    df.write.parquet(path)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path), (dict(seen.get) if watch else {}) | {"path": path}


def remove(spark: SparkSession, path: str) -> None:
    """Delete one stored table that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the tables stored inside on leaving, but for those whose paths are put on the list that this gives.

    What is read after leaving must not depend on the others.
    """
    begin, kept = len(_STORED), []
    try:
        yield kept
    finally:
        for path in _STORED[begin:]:
            if path not in kept:
                remove(spark, path)
        _STORED[begin:] = kept


def one_per_id(docs: DataFrame, key: str = "doc_id", value: str = "text") -> DataFrame:
    """(key, value), one row per key: of rows with one key the greatest value stays (a null only where all are null).

    Keys that occur more than once are looked up first; only their rows are grouped, so texts are not shuffled. A null
    key is a key like any other.
    """
    rows = docs.select(key, value)
    again, seen = store(rows.groupBy(key).count().where("count > 1").select(F.col(key).alias("again")),
                        "repeated-ids", {"n": F.count(F.lit(1))})
    if not seen["n"]:
        remove(docs.sparkSession, seen["path"])
        return rows
    same = rows[key].eqNullSafe(again["again"])
    merged = rows.join(again, same, "left_semi").groupBy(key).agg(F.max(value).alias(value))
    return rows.join(again, same, "left_anti").unionByName(merged)


def least_hashed(rows: DataFrame, most: int, hashed: str = "h") -> DataFrame:
    """About the ``most`` rows with the smallest hashes; only hashes reach the driver to find the last one."""
    last = rows.select(hashed).orderBy(hashed).limit(most).agg(F.max(hashed)).first()[0]
    return rows.where(F.col(hashed) <= F.lit(last)) if last is not None else rows.limit(0)


# -- Arrow batches -----------------------------------------------------------------------------------------------------

def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice hold about a megabyte; a longer text is a slice of its own."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > begin and held + size > SLICE_BYTES:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if batch.num_rows > begin:
            yield batch.slice(begin)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its texts (null: empty)."""
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


# -- hashes ------------------------------------------------------------------------------------------------------------

def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = (x ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64), 0x5EED)
BASE = 0xD1342543DE82EF95
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from one pass of prefix sums over the bytes."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * _powers(BASE, len(data)), out=prefix[1:])
    value = (prefix[ends] - prefix[starts]) * _powers(BASE_INVERSE, len(data) + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts between ASCII white space: their hashes, byte starts and the first word of each text.

    The last array has one entry more than there are texts.
    """
    if lower:
        upper = (data >= 65) & (data <= 90)
        data = np.where(upper, data + 32, data).astype(np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate(([False], inside))[:-1] if len(data) else inside
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return span_hashes(data, starts, ends), starts, np.searchsorted(starts, offsets)


def rolling(values: np.ndarray, size: int) -> np.ndarray:
    """The polynomial of each ``size`` consecutive values; longer ones are put together from two of half the length."""
    n = max(0, len(values) - size + 1)
    if not n:
        return np.zeros(0, np.uint64)
    out, done, block, width = None, 0, values, 1
    while size:
        power = np.uint64(pow(BASE, width, 1 << 64))
        if size & 1:
            m = len(values) - done - width + 1
            out = block if out is None else out[:m] * power + block[done:done + m]
            done += width
        size >>= 1
        if size:
            block = block[:len(block) - width] * power + block[width:]
            width *= 2
    return out[:n]


def grams(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words and which of them lie within one text.

    Entry i begins at word i; both arrays are as long as there are such starts in the whole batch.
    """
    out = rolling(hashes, size)
    n = len(out)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return mix(out), owner[:n] == owner[size - 1:size - 1 + n]


def distinct_sets(values: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values per owner, flat, and the offsets of the owners' runs. Owners ascend."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(texts + 1))


def reduce_runs(ufunc: np.ufunc, values: np.ndarray, runs: np.ndarray, empty: int) -> np.ndarray:
    """``ufunc`` over each run of a flat array; ``empty`` for empty runs."""
    out = np.full(len(runs) - 1, empty, values.dtype)
    full = np.flatnonzero(np.diff(runs))
    if len(full):
        out[full] = ufunc.reduceat(values, runs[:-1][full])
    return out


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """Rows of a contiguous matrix as a binary column."""
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))])


# -- keys that can be null, and joins that leave large texts where they are -------------------------------------------

NO_ID = -(1 << 63)


def keyed(docs: DataFrame, key: str = "doc_id", value: str = "text") -> DataFrame:
    """:func:`one_per_id` with the smallest bigint in place of a null key, so that it joins like any other.

    Every operator on documents begins here, so this also bounds the Arrow batches in which texts go to Python.
    """
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return one_per_id(docs, key, value).withColumn(key, F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)))


def unkeyed(key: str = "doc_id") -> Column:
    return F.nullif(F.col(key), F.lit(NO_ID)).alias(key)


def only(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is in the stored table ``ids``.

    Small tables are broadcast by their known size. For others Spark's runtime filter keeps most other texts out of the
    shuffle; the filter has a fixed size, and what it lets through by chance goes in the join.
    """
    conf = docs.sparkSession.conf
    conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "10g")
    return docs.join(ids.where(F.col(key) >= F.lit(NO_ID)), key, "left_semi")
