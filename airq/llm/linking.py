"""Links and components of similar sets from MinHash signatures, without forming all pairs of a bucket.

Candidates share a band. Each member of a bucket is first compared with two centres, one that the bands have in common
as far as they can and one of the bucket's own. Then components are known for nearly all, and the last round compares,
within the buckets that still hold several components, every member outside the largest one with all members. It does so
in blocks that hold the full sets, so no pair is a row of a table, and it stops at the first link to a component. After
it no pair of a bucket from different components is unchecked: the components are those of all banded pairs, though a
group of n similar sets costs about n comparisons.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from airq.llm.common import binary_rows, mix, only, reduce_runs, scratch, slices, store
from airq.llm.components import components

#: Signature entries compared at a time.
BATCH = 16
#: Members of one side of a block in the last round.
BLOCK = 256
#: Pairs of a block, and values of sets, that are compared at a time.
PAIRS, VALUES = 1 << 15, 1 << 18


@dataclass(frozen=True)
class Sets:
    """The full sets of some items.

    ``read`` gives (id, members binary) of a stored table of ids, ``decode`` turns some of these into ascending 64-bit
    values, none empty, flat with the offsets of the sets' runs. What travels between the two is the smaller of the set
    and what it is made from.
    """
    read: Callable[[DataFrame], DataFrame]
    decode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def decoded(members: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sets that travel as their values."""
    return np.frombuffer(b"".join(members), np.uint64), _offsets([len(x) // 8 for x in members])


def _offsets(sizes: list[int] | np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


@dataclass(frozen=True)
class Banding:
    """``entries`` signature entries, of which the first bands * rows are cut into bands."""
    bands: int
    rows: int
    entries: int

    def buckets(self, sig: str = "sig") -> Column:
        """The bucket of each band: a hash of the band's entries and its number."""
        width = 2 * self.rows
        return F.array(*[F.xxhash64(F.substring(sig, b * width + 1, width), F.lit(b)) for b in range(self.bands)])


def signatures(values: np.ndarray, runs: np.ndarray, entries: int) -> pa.Array:
    """MinHash signatures, 16 bits an entry, of runs of 64-bit values, as a binary column."""
    odd = mix(np.arange(entries, dtype=np.uint64), 7).astype(np.uint32) | np.uint32(1)
    flip = mix(np.arange(entries, dtype=np.uint64), 11).astype(np.uint32)
    narrow = (values >> np.uint64(32)).astype(np.uint32)
    sig = np.empty((len(runs) - 1, entries), np.uint32)
    held = np.empty_like(narrow)
    for i in range(entries):
        np.bitwise_xor(narrow, flip[i], out=held)
        np.multiply(held, odd[i], out=held)
        sig[:, i] = reduce_runs(np.minimum, held, runs, 0xFFFFFFFF)
    return binary_rows((mix(sig.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16))


def least_matches(similarity: float, miss: float, entries: int) -> list[int]:
    """Per batch, the fewest equal entries with which a pair stays.

    With a uniform prior the chance that the similarity is at least t after m of n equal entries is that of at most m
    successes in n + 1 trials of chance t. A pair goes where it is below ``miss``, split over the looks.
    """
    looks = entries // BATCH
    out = []
    for n in range(BATCH, entries + 1, BATCH):
        chance, m = 0.0, 0
        while m <= n:
            chance += math.comb(n + 1, m) * similarity ** m * (1 - similarity) ** (n + 1 - m)
            if chance >= miss / looks:
                break
            m += 1
        out.append(m)
    return out


def surviving(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of two signature matrices pass every look of the sequential test."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int32)
    for look, fewest in enumerate(least):
        at = slice(look * BATCH, look * BATCH + BATCH)
        equal[alive] += (a[alive, at] == b[alive, at]).sum(1, dtype=np.int32)
        alive = alive[equal[alive] >= fewest]
    return alive


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _pruned(pairs: DataFrame, items: DataFrame, percent: int, least: list[int]) -> DataFrame:
    """Of candidate pairs (u, v), those that sizes and signatures leave possible."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = surviving(_matrix(batch.column(2)), _matrix(batch.column(3)), least)
            yield batch.select(["u", "v"]).take(pa.array(keep))

    a = items.select(F.col("id").alias("u"), F.col("size").alias("size_u"), F.col("sig").alias("sig_u"))
    b = items.select(F.col("id").alias("v"), F.col("size").alias("size_v"), F.col("sig").alias("sig_v"))
    near = pairs.join(a, "u").join(b, "v").where(
        F.isnull("size_u") | F.isnull("size_v") | (100 * F.least("size_u", "size_v") >= percent * F.greatest("size_u", "size_v")))
    return near.select("u", "v", "sig_u", "sig_v").mapInArrow(task, "u long, v long")


def _confirmed(pairs: DataFrame, sets: DataFrame, decode: Callable, percent: int) -> DataFrame:
    """Of candidate pairs, those with 100 * intersection >= percent * union."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in slices(batches, "set_u") for part in slices(iter([b]), "set_v")):
            # A set that stands in several pairs is decoded once.
            both = pa.concat_arrays([batch.column(c) for c in ("set_u", "set_v")]).dictionary_encode()
            at, n = both.indices.to_numpy(), batch.num_rows
            keep = np.flatnonzero(_linked(*decode(both.dictionary.to_pylist()), at[:n], at[n:], percent))
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    for side in ("u", "v"):
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("members").alias(f"set_{side}")), side)
    return pairs.select("u", "v", "set_u", "set_v").mapInArrow(task, "u long, v long")


def _linked(flat: np.ndarray, runs: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (a[i], b[i]) of ascending runs are linked; no run is empty."""
    sizes = np.diff(runs)
    out = 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
    left = np.flatnonzero(out)
    cost, done = np.cumsum(sizes[a[left]] + sizes[b[left]]), 0
    while done < len(left):
        end = max(done + 1, int(np.searchsorted(cost, (cost[done - 1] if done else 0) + VALUES)))
        i = left[done:end]
        both = shared(flat, runs, a[i], b[i])
        out[i] = 100 * both >= percent * (sizes[a[i]] + sizes[b[i]] - both)
        done = end
    return out


def shared(flat: np.ndarray, runs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values the runs of each pair (a[i], b[i]) have in common.

    The number of the pair and the upper bits of a value are one ascending key, so one search serves all pairs. Where two
    values of a run have the same key, its pair is looked at by itself.
    """
    bits = max(1, (len(a) - 1).bit_length())

    def keys(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = runs[rows + 1] - runs[rows]
        pair = np.repeat(np.arange(len(rows)), sizes)
        values = flat[np.arange(len(pair)) + np.repeat(runs[rows] - _offsets(sizes)[:-1], sizes)]
        return pair, values, pair.astype(np.uint64) << np.uint64(64 - bits) | values >> np.uint64(bits)

    (pair, x, held), (other, y, asked) = keys(a), keys(b)
    at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
    both = np.bincount(other[(held[at] == asked) & (x[at] == y)], minlength=len(a))
    for i in np.unique(pair[1:][held[1:] == held[:-1]]):
        both[i] = len(np.intersect1d(x[pair == i], y[other == i], assume_unique=True))
    return both


def _compared(block: dict[str, np.ndarray], cuts: np.ndarray, least: list[int], percent: int) -> Iterator[np.ndarray]:
    """Links (u, v, lu, lv) among the rows of some whole blocks that begin at ``cuts``, a link for each left member and label.

    Of a member's partners with one label the likeliest is compared first, then twice as many, until there is a link.
    """
    flat, runs = np.concatenate(block["members"]), _offsets(block["size"])
    number = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    left, right = np.flatnonzero(block["is_left"]), np.flatnonzero(~block["is_left"])
    first = np.searchsorted(number[right], np.arange(len(cuts)))
    many = np.diff(first)[number[left]]
    ends, done = np.cumsum(many), 0
    while done < len(left):
        end = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS)))
        some, n = left[done:end], many[done:end]
        done = end
        i = np.repeat(some, n)
        j = right[np.arange(len(i)) + np.repeat(first[number[some]] - _offsets(n)[:-1], n)]
        one, other = block["size"][i], block["size"][j]
        fit = (block["label"][i] != block["label"][j]) & (100 * np.minimum(one, other) >= percent * np.maximum(one, other))
        i, j = i[fit], j[fit]
        a, b = block["sig"][i], block["sig"][j]
        alive = surviving(a, b, least)
        i, j, equal = i[alive], j[alive], (a[alive] == b[alive]).sum(1)
        order = np.lexsort((-equal, block["label"][j], i))
        i, j = i[order], j[order]
        begins = np.append(True, (i[1:] != i[:-1]) | (block["label"][j][1:] != block["label"][j][:-1]))[:len(i)]
        group = np.cumsum(begins) - 1
        rank = np.arange(len(i)) - np.flatnonzero(begins)[group]
        have, look = np.zeros(len(i), bool), 1
        while len(i):
            now = rank < look
            found = np.flatnonzero(now)[_linked(flat, runs, i[now], j[now], percent)]
            yield np.stack([block[k][x[found]] for k, x in (("id", i), ("id", j), ("label", i), ("label", j))], axis=1)
            have[group[found]] = True
            rest = ~now & ~have[group]
            i, j, group, rank = i[rest], j[rest], group[rest], rank[rest]
            look = 2 * look + 1


def _blocks(left: DataFrame, right: DataFrame, decode: Callable, least: list[int], percent: int) -> DataFrame:
    """Confirmed links (u, v, lu, lv) among all pairs left x right of a block whose labels differ.

    A link for each left member and label is enough; the other pairs of the two would tell nothing new.
    """
    names = ["bucket", "lb", "rb", "id", "label", "is_left"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for last, batch in _with_end(part for b in batches for part in slices(iter([b]), "members")):
            if batch is not None:
                new = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names} | {"sig": _matrix(batch.column("sig"))}
                flat, runs = decode(batch.column("members").to_pylist())
                new["members"] = np.empty(batch.num_rows, object)
                new["members"][:] = [flat[p:q] for p, q in zip(runs[:-1], runs[1:])]
                new["size"] = np.diff(runs)
                held = new if held is None else {n: np.concatenate([held[n], new[n]]) for n in new}
            if held is None:
                continue
            key = np.stack([held["bucket"], held["lb"], held["rb"]])
            cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [key.shape[1]]])
            whole = cuts if last else cuts[:-1]
            if whole[-1] == 0:
                continue
            found = list(_compared({k: x[:whole[-1]] for k, x in held.items()}, whole, least, percent))
            held = {k: x[whole[-1]:] for k, x in held.items()}
            links = np.unique(np.concatenate([np.empty((0, 4), np.int64), *found]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, i]) for i in range(4)], ["u", "v", "lu", "lv"])

    rows = left.withColumn("is_left", F.lit(True)).unionByName(right.withColumn("is_left", F.lit(False)))
    dealt = rows.select(*names, "sig", "members").repartition("bucket", "lb", "rb").sortWithinPartitions("bucket", "lb", "rb")
    return dealt.mapInArrow(task, "u long, v long, lu long, lv long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch | None]]:
    for batch in batches:
        yield False, batch
    yield True, None


def _labelled(rows: DataFrame, labels: DataFrame, key: str = "id", name: str = "label") -> DataFrame:
    found = labels.select(F.col("id").alias(key), F.col("component").alias(name))
    return rows.join(found, key, "left").withColumn(name, F.coalesce(name, key))


def components_of(items: DataFrame, banding: Banding, sets: Sets, percent: int = 80, miss: float = 1e-4) -> DataFrame:
    """(id, component) of the linked items.

    ``items`` is (id bigint, size bigint, sig binary) of different sets that are not empty, a null size is not known;
    equal rows may repeat. A pair at the limit is missed by the bands with a chance of
    (1 - similarity^rows)^bands and by the sequential test with one of ``miss``.
    """
    with scratch(items.sparkSession) as kept:
        labels, seen = store(_components_of(items, banding, sets, percent, miss), "components")
        kept.append(seen["path"])
    return labels


def _components_of(items: DataFrame, banding: Banding, sets: Sets, percent: int, miss: float) -> DataFrame:
    least = least_matches(percent / 100, miss, banding.entries)
    one = Window.partitionBy("bucket")
    members = items.select("id", F.explode(banding.buckets()).alias("bucket")).select(
        "bucket", "id", F.min("id").over(one).alias("a"), F.max("id").over(one).alias("b")).where("a <> b")
    members, _ = store(members.select("bucket", "id").distinct(), "members")
    banded, _ = store(members.select("id").distinct(), "banded-ids")
    items, _ = store(only(items, banded, "id").dropDuplicates(["id"]), "banded")
    # The member whose id, scrambled, is smallest is a centre; scrambling by exclusive or can be undone.
    scrambles = [F.lit(0x1B873593), F.col("bucket")]
    centres = members.groupBy("bucket").agg(F.array(*[F.min(F.col("id").bitwiseXOR(x)).bitwiseXOR(x) for x in scrambles]).alias("centres"))
    pairs = members.join(centres, "bucket").select("id", F.explode("centres").alias("centre")).where("id <> centre").select(
        F.greatest("id", "centre").alias("u"), F.least("id", "centre").alias("v")).distinct()
    pairs, _ = store(_pruned(pairs, items, percent, least), "survivors")
    ids, _ = store(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), "ids")
    links, _ = store(_confirmed(pairs, store(sets.read(ids), "sets")[0], sets.decode, percent), "confirmed")
    labels = components(links)

    mixed, _ = store(_labelled(members, labels), "labelled")
    each = mixed.groupBy("bucket", "label").count()
    main = each.groupBy("bucket").agg(F.max(F.struct("count", "label")).alias("m"), F.sum("count").alias("n"),
                                      F.count(F.lit(1)).alias("labels")).where("labels > 1 and n > 2").select(
        "bucket", F.col("m.label").alias("main"), F.ceil((F.col("n") - F.col("m.count")) / BLOCK).cast("int").alias("nl"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("nr"))
    mixed, seen = store(mixed.join(main, "bucket"), "mixed", {"n": F.count(F.lit(1))})
    if not seen["n"]:
        return labels
    ids, _ = store(mixed.select("id").distinct(), "ids")
    rows = mixed.join(items.join(sets.read(ids), "id"), "id")

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    rows, _ = store(rows, "blocks")
    left = rows.where("label <> main").withColumn("lb", block("nl")).withColumn("rb", every("nr"))
    right = rows.withColumn("rb", block("nr")).withColumn("lb", every("nl"))
    more, seen = store(_blocks(left, right, sets.decode, least, percent), "confirmed", {"n": F.count(F.lit(1))})
    if not seen["n"]:
        return labels
    joined = components(more.select(F.col("lu").alias("u"), F.col("lv").alias("v")))
    lone = more.select(F.col("u").alias("id"), F.col("lu").alias("component")).union(more.select("v", "lv"))
    every_label = labels.unionByName(lone).distinct().withColumnRenamed("component", "old")
    joined = joined.withColumnRenamed("id", "old")
    return every_label.join(joined, "old", "left").select("id", F.coalesce("component", "old").alias("component")).distinct()
