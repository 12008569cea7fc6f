"""Packing by lexical retrieval: a window is filled with unused documents that are close to its seed by BM25.

Document frequencies and lengths are counted over all documents, whole ones. What is left of each after its whole windows
is dealt to shards by its words: sketches of BM25 weights go down a tree of principal directions, so that neighbours tend
to share a shard. Each shard has its inverted index, so shards are packed at the same time and a lost one is packed again
alone. A seed does not see the neighbours in other shards; one shard for all (``shard`` above the number of documents) does.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from airq.llm.common import keyed, mix, store, unkeyed

#: Documents of a shard on average.
SHARD = 2_048
#: Numbers of a sketch; one of so many documents at most gives its sketch to the tree, about SKETCHES in all at most.
SKETCH, ONE_OF, SKETCHES = 256, 64, 1 << 16
#: Leaves of the tree; beyond, each is parted by a hash of the ids, so that tree and sample stay bounded.
LEAVES = 2_048
#: A cut of the tree lies so near the middle of its sample, as a share.
NEAR = 0.1
#: Share of a shard's documents from which a term's weights are a dense row.
OFTEN = 1 / 8
#: Documents of a shard up to which the sums over frequent terms are held for every two of them.
CROWDED = 6_000
#: Neighbours that are put in order before the others.
FIRST = 32
K1, B = 1.2, 0.75
#: Separates documents within a sequence.
END = 0


def _encoder(path: str):
    """Ids of a text as the tokenizers library gives them for this byte-level BPE file, by the faster tiktoken.

    The file's vocabulary in order of ids is the order of merges, so it serves as ranks. A test compares both.
    """
    import json

    import tiktoken
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    coder = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: coder.encode_to_numpy(text, allowed_special="all")


TOKENS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rest binary"


def tokenized(docs: DataFrame, tokenizer: str, window: int) -> DataFrame:
    """Whole windows of long documents as finished pieces, and each document's rest with its ids.

    A task ends with a row of ``start`` -1 that counts, for each token id, its whole documents that hold it.
    """
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, held = _encoder(tokenizer), np.zeros(0, "<i8")
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                ids = np.append(encode(text), END).astype("<u4")
                if (top := int(ids.max())) >= len(held):
                    held = np.append(held, np.zeros(max(top + 1, 2 * len(held)) - len(held), np.int64))
                held[ids] += 1  # once for each id, however often it stands there
                cut = len(ids) // window * window
                rows += [(doc_id, at, window, zlib.crc32(ids[at:at + window].tobytes()), len(ids), None) for at in range(0, cut, window)]
                if cut < len(ids):
                    rows.append((doc_id, cut, len(ids) - cut, 0, len(ids), ids[cut:].astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes()))
                if len(rows) >= 4096:
                    yield pd.DataFrame(rows, columns=_names(TOKENS))
                    rows = []
            yield pd.DataFrame(rows, columns=_names(TOKENS))
        yield pd.DataFrame([(None, -1, 0, 0, 0, held.astype("<i8").tobytes())], columns=_names(TOKENS))

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(task, TOKENS)


def _added(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Sum of two arrays of counts, of which one may be shorter."""
    out = np.zeros(max(len(one), len(other)), np.int64)
    out[:len(one)] += one
    out[:len(other)] += other
    return out


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


class Corpus:
    """Weights by the statistics of all documents: how many hold each token id, their number and mean length."""

    def __init__(self, held: np.ndarray, n: int, tokens: int):
        self.idf = np.log1p((n - held + 0.5) / (held + 0.5))
        self.mean = max(tokens / max(n, 1), 1)

    def weights(self, terms: np.ndarray, often: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return self.idf[terms] * often * (K1 + 1) / (often + K1 * (1 - B + B * size / self.mean))


def corpus_of(texts: list[np.ndarray]) -> Corpus:
    flat = [np.unique(t) for t in texts]
    return Corpus(np.bincount(np.concatenate(flat)) if flat else np.zeros(0), len(texts), sum(map(len, texts)))


def _texts(frame: pd.DataFrame) -> list[np.ndarray]:
    """The ids of documents' rests."""
    return [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4").astype("<u4") for x, n in zip(frame["rest"], frame["length"])]


def corpus_statistics(pieces: DataFrame, n: int, tokens: int) -> Corpus:
    """Sums of the tasks' counts; as many numbers as the vocabulary has entries reach the driver."""
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(0, np.int64)
        for frame in frames:
            for counts in frame["rest"]:
                held = _added(held, np.frombuffer(counts, "<i8"))
        terms = np.flatnonzero(held)
        yield pd.DataFrame({"term": terms, "held": held[terms]})

    rows = pieces.where("start = -1").select("rest").mapInPandas(task, "term long, held long")
    rows = rows.groupBy("term").agg(F.sum("held").alias("held")).toPandas()
    held = np.zeros(int(rows["term"].max()) + 1 if len(rows) else 0)
    held[rows["term"].to_numpy(np.int64)] = rows["held"]
    return Corpus(held, n, tokens)


def sketches(texts: list[np.ndarray], ids: np.ndarray, corpus: Corpus) -> np.ndarray:
    """Unit vectors of random sums of the weights, and a last number by the id that parts equal ones.

    Each token id adds its weight, with a sign, to one of the sums.
    """
    terms = mix(np.arange(len(corpus.idf), dtype=np.uint64), 0x51C7)
    place, sign = (terms % np.uint64(SKETCH)).astype(np.int64), np.where(terms >> np.uint64(63), 1.0, -1.0)
    out = np.zeros((len(texts), SKETCH + 1), np.float32)
    for i, text in enumerate(texts):
        held, often = np.unique(text, return_counts=True)
        out[i, :-1] = np.bincount(place[held], corpus.weights(held, often, len(text)) * sign[held], SKETCH)
    out /= np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)
    out[:, -1] = mix(ids.astype(np.int64).view(np.uint64), 0xDEA1) / np.float64(1 << 64)
    return out


def tree(sample: np.ndarray, leaves: int) -> list[tuple]:
    """Nodes (direction, cut, leaves on the left, left child, right child), cut along principal directions.

    The cut is the widest gap near the middle; leaves are shared out by what lies on both sides.
    """
    nodes: list[tuple] = []

    def grow(rows: np.ndarray, leaves: int) -> int | None:
        if leaves == 1:
            return None
        at, left = len(nodes), leaves // 2
        nodes.append(())
        direction = np.zeros(SKETCH + 1, np.float32)
        if len(rows) > 1:
            centred = rows[:, :-1] - rows[:, :-1].mean(axis=0)
            direction[:-1] = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        direction[-1] = 1e-3
        along = rows @ direction
        cut = np.quantile(along, left / leaves) if len(rows) else 0.0
        line = np.sort(along)[int(len(rows) * (0.5 - NEAR)):int(len(rows) * (0.5 + NEAR)) + 1]
        if leaves % 2 == 0 and len(line) > 2:
            widest = np.argmax(np.diff(line))
            cut = (line[widest] + line[widest + 1]) / 2
            left = min(max(round(leaves * float((along < cut).mean())), 1), leaves - 1)
        low = along < cut
        nodes[at] = (direction, cut, left, grow(rows[low], left), grow(rows[~low], leaves - left))
        return at

    grow(sample, leaves)
    return nodes


def leaf_of(nodes: list[tuple], rows: np.ndarray) -> np.ndarray:
    out, open_ = np.zeros(len(rows), np.int32), [(0 if nodes else None, np.arange(len(rows)), 0)]
    while open_:
        at, some, first = open_.pop()
        if at is None or not len(some):
            out[some] = first
            continue
        direction, cut, left, one, other = nodes[at]
        low = rows[some] @ direction < cut
        open_ += [(one, some[low], first), (other, some[~low], first + left)]
    return out


def sample_rate(n: int) -> int:
    """One of so many documents gives its sketch: SKETCHES are expected at most, however many documents there are."""
    return max(ONE_OF, -(-n // SKETCHES))


def dealt(open_: DataFrame, shards: int, corpus: Corpus, n: int) -> DataFrame:
    """The rests ``open_``, ``n`` in number, each with its shard."""
    if shards == 1:
        return open_.withColumn("shard", F.lit(0))
    leaves = min(shards, LEAVES)
    parts = -(-shards // leaves)

    def sketched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"sketch": [x.tobytes() for x in sketches(_texts(frame), frame["doc_id"].to_numpy(), corpus)]})

    chosen = open_.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(sample_rate(n))) == 0).select("doc_id", "length", "rest")
    sample = chosen.mapInPandas(sketched, "sketch binary").toPandas()["sketch"]
    sample = np.frombuffer(b"".join(map(bytes, sample)), np.float32).reshape(-1, SKETCH + 1)
    nodes = tree(sample[np.lexsort(sample.T)], leaves)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["shard"] = leaf_of(nodes, sketches(_texts(frame), frame["doc_id"].to_numpy(), corpus))
            yield frame

    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(parts)).cast("int")
    return open_.mapInPandas(task, f"{TOKENS}, shard int").withColumn("shard", F.col("shard") * parts + part)


class Index:
    """BM25 postings of one shard's documents, weighed by the whole corpus; used ones are masked."""

    def __init__(self, texts: list[np.ndarray], corpus: Corpus | None = None):
        corpus, n = corpus or corpus_of(texts), len(texts)
        self.terms, counts = zip(*[np.unique(t, return_counts=True) for t in texts]) if n else ((), ())
        sizes = np.array([len(t) for t in texts], float)
        flat = np.concatenate(self.terms) if n else np.empty(0, np.uint32)
        owner = np.repeat(np.arange(n), [len(t) for t in self.terms])
        weight = corpus.weights(flat, np.concatenate(counts) if n else np.empty(0), sizes[owner])
        order = np.argsort(flat, kind="stable")
        self.vocabulary, self.begin, self.held = np.unique(flat[order], return_index=True, return_counts=True)
        self.owner, self.weight = owner[order], weight[order]
        often = self.held > max(1, n * OFTEN)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((int(often.sum()), n), np.float32)
        row = np.repeat(self.row, self.held)
        self.dense[row[row >= 0], self.owner[row >= 0]] = self.weight[row >= 0]
        self.unused = np.ones(n, bool)
        # What frequent terms add between all documents of the shard, from one product; a crowded shard asks seed by seed.
        self.common = None
        if n <= CROWDED:
            asked = np.zeros((len(self.dense), n), np.float32)
            asked[row[row >= 0], self.owner[row >= 0]] = 1
            self.common = asked.T @ self.dense

    def _common(self, seed: int, rows: np.ndarray) -> np.ndarray:
        """Sums over the seed's frequent terms."""
        if self.common is not None:
            return self.common[seed].astype(float)
        return self.dense[rows[rows >= 0]].sum(axis=0, dtype=np.float32).astype(float)

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents that share a term of the seed, best first by all its terms, equals in order."""
        at = np.searchsorted(self.vocabulary, self.terms[seed])
        rows = self.row[at]
        score = self._common(seed, rows)
        rare = at[(rows < 0) & (self.held[at] > 1)]
        if len(rare):
            held = self.held[rare]
            where = np.repeat(self.begin[rare] - np.cumsum(held) + held, held) + np.arange(held.sum())
            score += np.bincount(self.owner[where], self.weight[where], len(score))
        found = np.flatnonzero((score > 0) & self.unused)
        score = score[found]
        # Most windows need few neighbours, so those are put in order first.
        first = score >= np.partition(score, -FIRST)[-FIRST] if len(found) > 4 * FIRST else np.ones(len(found), bool)
        for part in (first, ~first):
            yield from found[part][np.argsort(-score[part], kind="stable")]


def fill(texts: list[np.ndarray], window: int, corpus: Corpus | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, begin, length).

    The first unused document is a seed. Its best unused neighbours follow until the window is full; the last is cut
    there, and what is left of it begins the next sequence and seeds it. Without a neighbour the next unused document
    follows, so only the last sequence of a shard is short. Without ``corpus`` the texts are all there is.
    """
    index, nxt, rest = Index(texts, corpus), 0, None
    while True:
        if rest is None:
            while nxt < len(texts) and not index.unused[nxt]:
                nxt += 1
            if nxt == len(texts):
                return
            rest = (nxt, 0)
        seed, begin = rest
        index.unused[seed] = False
        pieces, room, rest = [(seed, begin, min(window, len(texts[seed]) - begin))], window - min(window, len(texts[seed]) - begin), None
        near = index.neighbours(seed) if room else iter(())
        while room:
            one = next(near, None)
            if one is None:
                while nxt < len(texts) and not index.unused[nxt]:
                    nxt += 1
                if nxt == len(texts):
                    break
                one = nxt
            if not index.unused[one]:
                continue
            index.unused[one] = False
            took = min(room, len(texts[one]))
            pieces.append((int(one), 0, took))
            room -= took
            if took < len(texts[one]):
                rest = (int(one), took)
        yield pieces


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, shard: int = SHARD) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece of a document.

    A document is its ids without special tokens and one id 0. Whole windows of a long document are sequences of their
    own; what is left of it is packed with its neighbours, see :func:`fill`. Pieces of a sequence follow without gaps
    from offset 0. Sequence ids hold the shard in their upper bits. ``tokenizer`` is a path on every executor.

    Null and empty texts are the one id 0. Repeated doc_ids count as one document (see
    :func:`airq.llm.common.one_per_id`), a null doc_id as one too. An empty table has no pieces. Further columns are
    not read. A shard holds ``shard`` documents on average, each with less than a window of ids; neighbours are sought
    in the seed's shard.
    """
    rest, whole = F.col("rest").isNotNull() & (F.col("start") >= 0), F.col("start") == 0
    pieces, seen = store(tokenized(keyed(docs), tokenizer, window), "tokens", {
        "n": F.count(F.when(whole, 1)), "tokens": F.coalesce(F.sum("length"), F.lit(0)), "rests": F.count(F.when(rest, 1))})
    shards = max(1, -(-seen["rests"] // shard))
    corpus = corpus_statistics(pieces, seen["n"], seen["tokens"])

    def task(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start"], kind="stable")
        rows, texts = [], _texts(frame)
        of = list(frame[["doc_id", "start", "doc_tokens"]].itertuples(index=False))
        for number, sequence in enumerate(fill(texts, window, corpus)):
            offset = 0
            for i, begin, length in sequence:
                crc = zlib.crc32(texts[i][begin:begin + length].tobytes())
                rows.append((of[i].doc_id, of[i].start + begin, length, crc, of[i].doc_tokens, number, offset))
                offset += length
        out = pd.DataFrame(rows, columns=_names(PIECES))
        out["sequence_id"] = (out["sequence_id"] + (int(key[0]) << 31)) * 2
        return out

    packed = dealt(pieces.where(rest), shards, corpus, seen["rests"]).groupBy("shard").applyInPandas(task, PIECES)
    # Whole windows are sequences already; they get odd numbers and need no shuffle.
    done = pieces.where("rest is null").withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return done.select(*_names(PIECES)).unionByName(packed).select(unkeyed(), *_names(PIECES)[1:])
