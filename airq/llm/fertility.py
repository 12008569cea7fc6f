"""Quality rules from how a public vocabulary splits a text: characters per token, byte fallback, token entropy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from airq.llm.common import grams, keyed, slices, store, text_bytes, unkeyed, words

SYMBOLS = b"#*$%&|<>"
#: Words whose tokens a task remembers.
REMEMBERED = 200_000
#: Bands are this many quartile ranges wide on each side of the quartiles.
WIDTH = 4.0
METRICS = ("chars_per_token", "fallback_share", "entropy")
SHAPE = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         "chars_per_token double, fallback_share double, entropy double")


def _counts(column: pa.Array) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols and n_repeat_words of each text."""
    data, offsets = text_bytes(column)
    hashes, _, first = words(data, offsets)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offsets[1:]] - total[offsets[:-1]]

    value, inside = grams(hashes, first, 3)
    at = np.flatnonzero(inside)
    owner = np.searchsorted(first, at, side="right") - 1
    order = np.lexsort((value[at], owner))
    v, o = value[at][order], owner[order]
    same = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    again = np.zeros(len(v), bool)
    again[1:] |= same
    again[:-1] |= same
    covered = np.zeros(len(hashes) + 1, np.int64)
    for j in range(3):
        covered[at[order][again] + j] = 1
    total = np.concatenate([[0], np.cumsum(covered)])
    return np.diff(first), per_text(~space & ((data & 0xC0) != 0x80)), per_text(symbol[data]), total[first[1:]] - total[first[:-1]]


def _repeated_lines(text: str, has_word) -> int:
    met: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line in met:
            repeats += 1
        elif has_word(line):
            met.add(line)
    return repeats


def _measure(vocabulary: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import sentencepiece
        pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        is_byte = np.array([pieces.IsByte(i) for i in range(pieces.vocab_size())])
        word, known = re.compile(r"[^\x20\x09-\x0D]+"), {}

        def fertility(text: str) -> tuple[float | None, float | None, float | None]:
            counts = Counter(word.findall(text))
            if not counts:
                return None, None, None
            new = [w for w in counts if w not in known]
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(counts)
            if new:
                known.update(zip(new, pieces.encode(new, num_threads=1)))
            ids, times = [], []
            for w, n in counts.items():
                own = known[w]
                ids += own
                times += [n] * len(own)
            often = np.bincount(ids, weights=times, minlength=1)
            held = often[often > 0]
            n = held.sum()
            share = held / n
            entropy = float(-(share * np.log2(share)).sum() / np.log2(n)) if n > 1 else 1.0
            return (sum(len(w) * c for w, c in counts.items()) / n, float(often[is_byte[:len(often)]].sum() / n), entropy)

        for batch in slices(batches, "text"):
            n_words, word_chars, symbols, repeated = _counts(batch.column("text"))
            texts = [t or "" for t in batch.column("text").to_pylist()]
            lines = [_repeated_lines(t, word.search) for t in texts]
            rates = list(zip(*[fertility(t) for t in texts]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n_words, word_chars, symbols, lines, repeated)],
                 *[pa.array(x, pa.float64()) for x in rates]], [x.split()[0] for x in SHAPE.split(", ")])
    return task


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fertility_rules(docs: DataFrame, vocabulary: str, group: str = "lang", width: float = WIDTH) -> DataFrame:
    """(doc_id, the base counts, base_failed, the three measures, kept), one row per doc_id.

    A SentencePiece vocabulary with byte fallback splits each word. ``chars_per_token`` and ``fallback_share`` are over
    the words' tokens, ``entropy`` is that of the tokens over the logarithm of their number. A document is rejected if
    it fails the base rules or a measure lies outside its language's band: from the lower quartile less ``width``
    quartile ranges to the upper quartile plus as many, over all documents of the language that pass the base rules.
    ``vocabulary`` is a path on every executor.

    Null and empty texts have no words, null measures and fail the base rules. A null language is one of its own.
    Repeated doc_ids count as one document (see :func:`airq.llm.common.one_per_id`), in the greatest language it has; a
    null doc_id counts as one. Further columns are not read.
    """
    whole = keyed(docs.select("doc_id", F.struct(F.col("text").isNotNull().alias("has"), "text", F.coalesce(F.col(group).cast("string"), F.lit("")).alias("of")).alias("row")), "doc_id", "row")
    rows = whole.select("doc_id", "row.text", "row.of")
    measured, _ = store(rows.select("doc_id", "text").mapInArrow(_measure(vocabulary), SHAPE), "fertility")
    measured = measured.withColumn("base_failed", _base_failed()).join(rows.select("doc_id", "of"), "doc_id")
    quartiles = measured.where("not base_failed").groupBy("of").agg(*[
        F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.75)), 10_000).alias(f"q_{m}") for m in METRICS])
    bands, _ = store(quartiles, "bands")
    joined = measured.join(bands, "of", "left")
    inside = F.lit(True)
    for m in METRICS:
        low, high = F.col(f"q_{m}")[0], F.col(f"q_{m}")[1]
        # A range that is nearly nothing would reject what differs by nothing.
        reach = width * F.greatest(high - low, F.lit(0.01))
        inside = inside & F.col(m).between(low - reach, high + reach)
    return joined.select(unkeyed(), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *METRICS,
                         (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))
