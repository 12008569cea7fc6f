"""Toxic documents by compression distance: two Zstandard dictionaries, one per class, and calibrated thresholds.

Both dictionaries hold the same ordinary text. The toxic one begins with what a trained dictionary of the words of toxic
documents, other than those that ordinary ones have too, adds. A window that the toxic dictionary compresses to fewer
bytes speaks for the label; how many windows gain how much is turned into a chance by a logistic regression.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from airq.llm.common import keyed, least_hashed, slices, store, unkeyed

#: Labelled documents used at most, toxic and ordinary ones, and the bytes of the longest one.
TOXIC, ORDINARY, LONGEST = 2_400, 5_000, 16_384
#: Bytes of the shared ordinary text and of the toxic part.
SHARED, OWN = 1 << 19, 3_072
#: Bytes of a window, which ends with the word that reaches them.
WINDOW = 128
LEVEL, MIN_MATCH = 9, 4
#: A word is of one class if it is in this many times the share of documents of the other.
CONTRAST = 8
STEPS = (2, 4, 6, 8)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Model:
    """Dictionaries and the calibration over :func:`features`; without weights every score is 0."""
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def scorer(self):
        """A function from a text to its score; compressors are made once per task."""
        if self.weights is None:
            return lambda text: 0.0
        plain, toxic = _packer(self.ordinary), _packer(self.toxic + self.ordinary)

        def score(text: str) -> float:
            row = (features(gains(windows(text), plain, toxic)) - self.mean) / self.scale
            return float(1 / (1 + np.exp(-np.clip(row @ self.weights[:-1] + self.weights[-1], -60, 60))))
        return score


def _packer(dictionary: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(dictionary), source_size=WINDOW,
                                                         write_content_size=0, min_match=MIN_MATCH)
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=held)


def windows(text: str) -> list[bytes]:
    """Whole words in lower case (A-Z), about ``WINDOW`` bytes together; an empty text is one empty window."""
    out, held, size = [], [], 0
    for word in text.encode().lower().split():
        held.append(word)
        size += len(word) + 1
        if size >= WINDOW:
            out.append(b" ".join(held) + b" ")
            held, size = [], 0
    if held or not out:
        out.append(b" ".join(held) + b" ")
    return out


def gains(parts: list[bytes], plain: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> np.ndarray:
    """Bytes that the toxic dictionary saves in each window."""
    return np.array([len(plain.compress(p)) - len(toxic.compress(p)) for p in parts], float)


def features(gain: np.ndarray) -> np.ndarray:
    gain = np.sort(gain)[::-1]
    over = [(gain >= k).sum() for k in STEPS]
    return np.array([gain[0], gain[:3].mean(), gain.mean(), *np.log1p(over), *(np.array(over) / len(gain)), np.log(len(gain))])


def _spread(texts: list[str]) -> Counter:
    """In how many of the texts each word is."""
    return Counter(w for t in texts for w in set(WORD.findall(t.encode().lower())))


def _toxic_dictionary(toxic: list[str], ordinary: Counter, texts: int) -> bytes:
    """What a dictionary of words learns that toxic texts have and ``texts`` ordinary ones hardly have."""
    mine, least = _spread(toxic), max(3, len(toxic) // 200)
    own = {w for w, n in mine.items() if n >= least and (n + 0.5) / len(toxic) >= CONTRAST * (ordinary[w] + 0.5) / texts}
    kept = (b" ".join(w for w in WORD.findall(t.encode().lower()) if w in own) for t in toxic)
    try:
        return zstandard.train_dictionary(OWN, [s for s in kept if len(s) >= 8]).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from
        return b" ".join(sorted(own))[:OWN]


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from all toxic texts and half of the ordinary ones.

    The calibration is learned on what a dictionary of half of the toxic texts does with the other half and with the
    other ordinary texts, so no text is judged by a dictionary that holds it.
    """
    if min(len(toxic), len(ordinary)) < 8:
        return Model(b"", b"")
    half, rest = ordinary[::2], ordinary[1::2]
    words = _spread(half)
    shared = b"\n".join(t.encode().lower() for t in sorted(half, key=lambda t: (len(t), t)))[:SHARED]
    packers = _packer(shared), _packer(_toxic_dictionary(toxic[::2], words, len(half)) + shared)
    x = np.array([features(gains(windows(t), *packers)) for t in [*toxic[1::2], *rest]])
    y = np.array([1.0] * len(toxic[1::2]) + [0.0] * len(rest))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.append(np.ones(len(w) - 1), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -60, 60)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
    return Model(shared, _toxic_dictionary(toxic, words, len(half)), mean, scale, w)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of labelled rows that are not held out, those whose ids have the least hashes."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    marked, _ = store(marked.withColumn("h", F.xxhash64("doc_id")), "labels")
    chosen = [least_hashed(marked.where(F.col("toxic") == label), most) for label, most in ((1, TOXIC), (0, ORDINARY))]
    ids, _ = store(chosen[0].unionByName(chosen[1]), "sample")
    rows = docs.join(ids, "doc_id").where(F.octet_length("text") <= LONGEST).orderBy("h", "doc_id").select("toxic", "text").collect()
    return fit([r.text for r in rows if r.toxic == 1], [r.text for r in rows if r.toxic == 0])


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per doc_id; score is the chance of label 1 from the whole text.

    Labels are learned from documents whose crc32(doc_id) mod 3 is not 1 only. Null and empty texts are scored as one
    empty window. Without eight labelled documents of each class every score is 0. Repeated doc_ids count as one document
    (see :func:`airq.llm.common.one_per_id`), a null doc_id as one too, which is not held out; repeated labels of a
    document count as the greatest. Further columns are not read.
    """
    docs = keyed(docs)
    model = train(docs, labels)  # half a megabyte, sent with the task

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in slices(batches, "text"):
            scores = [score(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(task, "doc_id long, score double")
    return scored.select(unkeyed(), "score").select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                                                    (F.col("score") >= threshold).cast("int").alias("predicted"))
