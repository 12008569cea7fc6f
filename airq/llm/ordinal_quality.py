"""Quality by ordinal regression: one weight vector over hashed text, ordered thresholds between the grades."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from airq.llm.common import keyed, least_hashed, slices, store, unkeyed
from airq.llm.toxicity import held_out

#: Hashed features, and graded documents (and the bytes of one) that are used at most.
SIZE, SAMPLE, LONGEST = 4_096, 4_000, 16_384
#: Words whose features a task remembers.
REMEMBERED = 200_000
STEPS, RATE, RIDGE = 300, 0.05, 1e-4
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shape(word: str) -> str:
    """Letters by case, digits and other characters, runs of one kind once: ``Ab3!!`` is ``Aa0!``."""
    kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word]
    return "".join(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1])[:16]


def featurizer() -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
    """A function from a whole text to indices and values: words, shapes, pairs of shapes, repeats of the word before.

    A feature's value is the logarithm of its count plus one; a text's values have length one.
    """
    known: dict[str, tuple[int, int]] = {}

    def at(name: str) -> int:
        return zlib.crc32(name.encode()) % (SIZE - 2)

    def features(text: str) -> tuple[np.ndarray, np.ndarray]:
        words = WORD.findall(text)
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words):
            if w not in known:
                s = shape(w)
                known[w] = at("w" + w.lower()), at("s" + s)
        pairs = [known[w] for w in words]
        shapes = [s for _, s in pairs]
        counts = Counter(w for w, _ in pairs)
        counts.update(shapes)
        for (a, b), n in Counter(zip(shapes, shapes[1:])).items():
            counts[(a * 31 + b * 17 + 7) % (SIZE - 2)] += n
        counts[SIZE - 2] += sum(a == b for a, b in zip(pairs, pairs[1:]))
        counts[SIZE - 1] += 1
        index = np.fromiter(counts.keys(), np.int64, len(counts))
        value = np.log1p(np.fromiter(counts.values(), float, len(counts)))
        return index, value / max(np.linalg.norm(value), 1e-9)
    return features


@dataclass(frozen=True)
class Ordinal:
    """P(grade <= k) = sigmoid(cuts[k] - weights . features); the cuts ascend. Grades are 0 to len(cuts)."""
    weights: np.ndarray
    cuts: np.ndarray

    def chances(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        return 1 - _sigmoid(self.cuts - self.weights[index] @ value)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: list[str], grades: list[int], top: int) -> Ordinal:
    """Maximum likelihood with a ridge. Without rows, or with one grade only, all weights are 0."""
    features, y = featurizer(), np.array(grades, int)
    counts = np.bincount(y, minlength=top + 1)[:top + 1] + 1.0
    below = np.cumsum(counts)[:-1] / counts.sum()
    cuts = np.log(below / (1 - below))
    if len(set(grades)) < 2:
        return Ordinal(np.zeros(SIZE), cuts)
    x = np.zeros((len(texts), SIZE), np.float32)
    for row, text in zip(x, texts):
        index, value = features(text)
        row[index] = value
    # The gaps between cuts are exponentials, so the cuts stay in order.
    p = np.concatenate([np.zeros(SIZE), [cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        w, gaps = p[:SIZE], np.exp(p[SIZE + 1:])
        cuts = p[SIZE] + np.concatenate([[0], np.cumsum(gaps)])
        edge = np.column_stack([np.zeros(len(y)), _sigmoid(cuts - (x @ w.astype(np.float32))[:, None]), np.ones(len(y))])
        slope = edge * (1 - edge)
        rows = np.arange(len(y))
        chance = np.maximum(edge[rows, y + 1] - edge[rows, y], 1e-9)
        of_score = (slope[rows, y + 1] - slope[rows, y]) / chance / len(y)
        of_cut = np.zeros(len(cuts))
        for k in range(len(cuts)):
            of_cut[k] = -(slope[:, k + 1] * ((y == k) * 1.0 - (y == k + 1)) / chance).sum() / len(y)
        later = np.cumsum(of_cut[::-1])[::-1]
        grad = np.concatenate([x.T @ of_score.astype(np.float32) + RIDGE * w, [later[0]], later[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        p = p - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Ordinal(p[:SIZE], p[SIZE] + np.concatenate([[0], np.cumsum(np.exp(p[SIZE + 1:]))]))


def grade_quality(docs: DataFrame, ratings: DataFrame, top: int, level: int = 1, least: float = 0.5) -> DataFrame:
    """(doc_id, held_out, expected_grade, tail, kept), one row per doc_id; ``tail`` is P(grade >= level), kept from ``least``.

    ``ratings`` is (doc_id, grade) with grades 0 to ``top``; the greatest counts where a document has several, and nulls
    and others are not used. Learned from at most ``SAMPLE`` rated documents that are not held out (crc32(doc_id) mod 3
    is 1), those whose ids have the least hashes; scored on whole texts. Null and empty texts have no words and are
    scored by what all texts share. Without ratings of two grades the score is the shares of the grades. Repeated doc_ids
    count as one document (see :func:`airq.llm.common.one_per_id`), a null doc_id as one too, not held out.
    """
    docs = keyed(docs)
    rated = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, top)).groupBy("doc_id").agg(F.max("grade").alias("grade")).where(~held_out())
    rated, _ = store(rated.withColumn("h", F.xxhash64("doc_id")), "ratings")
    ids, _ = store(least_hashed(rated, SAMPLE), "sample")
    sample = docs.join(ids, "doc_id").where(F.octet_length("text") <= LONGEST).orderBy("h", "doc_id").select("text", "grade").collect()
    model = fit([r.text for r in sample], [int(r.grade) for r in sample], top)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = featurizer()
        for batch in slices(batches, "text"):
            tails = [model.chances(*features(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([float(t.sum()) for t in tails]), pa.array([float(t[level - 1]) for t in tails])],
                                             ["doc_id", "expected_grade", "tail"])

    scored = docs.select("doc_id", "text").mapInArrow(task, "doc_id long, expected_grade double, tail double")
    return scored.select(unkeyed(), "expected_grade", "tail").select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "expected_grade", "tail", (F.col("tail") >= least).alias("kept"))
