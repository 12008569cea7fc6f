"""Prefix trie of conversations; sums over subtrees by depth bands.

A node is named by its depth and its smallest member. Each conversation owns the nodes of which it is the smallest member:
its path from some depth to its end. A node adds to its ancestors within its band only; the roots of the bands form a
trie of their own that is summed in the same way, and their totals go to the band above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from airq.llm.common import scratch, store
from airq.llm.numbering import numbered

#: Depths of a band.
BAND = 16
#: Positions whose codes one task adds up before parts meet, and conversation ids that one part of a list spans.
PART, IDS = 256, 4096
#: Fixed values of the rebuilt conversations: ids with one opening, and remainders of the checksum.
FAMILY, OPENINGS = 100, 6


def ordered_turns(chats: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): turns in order of (turn, role, text), nulls first, numbered from 0."""
    rows = chats.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                                                     F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    codes = F.sha2(F.concat_ws("\n", F.char_length("role").cast("string"), "role", "text"), 256)
    placed = numbered(rows, order, "turns", "tie").select("conv_id", "position", codes.alias("code"), F.char_length("text").cast("long").alias("chars"))
    first, _ = store(placed.groupBy("conv_id").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("turns")), "conversations")
    return placed.join(first, "conv_id").select("conv_id", (F.col("position") - F.col("first")).alias("pos"), "turns", "code", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, code, chars) of the rebuilt conversations, and (conv_id, turns) of all, also those without turns.

    The first h turns of conversation c are those of conversation c - c % 100, with h the checksum of c modulo 6; its own
    turns follow after its first h.
    """
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    each = turns.where("pos = 0").select("conv_id", family.alias("family"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENINGS).alias("h"), F.col("turns").alias("own"))
    heads = turns.where((family == F.col("conv_id")) & (F.col("pos") < OPENINGS)).select(
        F.col("conv_id").alias("family"), "pos", "code", "chars", F.col("turns").alias("opening"))
    lengths = heads.where("pos = 0").select("family", "opening")
    each, _ = store(each.join(lengths, "family", "left").withColumn("taken", F.least("h", F.coalesce("opening", F.lit(0)))).select(
        "conv_id", "family", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns")), "rebuilt-lengths")
    opening = each.join(heads.drop("opening"), "family").where("pos < h").select("conv_id", "pos", "code", "chars")
    own = turns.drop("turns").join(each.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "code", "chars")
    return opening.unionByName(own), each.select("conv_id", "turns")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, chars): the codes of the prefix that ends with each turn and of the one before it.

    A prefix has the exclusive or of 120 bits of a SHA-256 for each of its (position, turn). A conversation is added up
    in parts of its positions, then the parts are put together.
    """
    digest = F.sha2(F.concat_ws(":", F.col("pos").cast("string"), "code"), 256)
    half = [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]
    rows = turns.select("conv_id", "pos", F.floor(F.col("pos") / PART).alias("part"), half[0].alias("x"), half[1].alias("y"), "chars")
    inside = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("a", F.bit_xor("x").over(inside)).withColumn("b", F.bit_xor("y").over(inside))
    whole = rows.where(F.col("pos") % PART == PART - 1).select("conv_id", (F.col("part") + 1).alias("part"), "a", "b")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Only conversations of more than one part have rows here.
    carried, _ = store(whole.select("conv_id", "part", F.bit_xor("a").over(before).alias("ca"), F.bit_xor("b").over(before).alias("cb")), "carried")
    x = rows.join(carried, ["conv_id", "part"], "left")
    a, b = (F.col(c).bitwiseXOR(F.coalesce(f"c{c}", F.lit(0))) for c in "ab")
    return x.select("conv_id", (F.col("pos") + 1).alias("depth"), a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("pa"), b.bitwiseXOR(F.col("y")).alias("pb"), "chars")


def _bands(paths: DataFrame, height: int, names: list[str]) -> DataFrame:
    """One row per conversation and band: ``path``, the band's (depth, node) in order, with the values of owned nodes."""
    own = F.col("node") == F.col("conv_id")
    values = [F.when(own, F.coalesce(n, F.lit(0))).otherwise(F.lit(0)).cast("long").alias(n) for n in names]
    return paths.groupBy("conv_id", F.floor(F.col("depth") / height).alias("band")).agg(
        F.array_sort(F.collect_list(F.struct("depth", "node", *values))).alias("path"))


def _from_below(path: Column, names: list[str]) -> Column:
    """The path with each value replaced by the sum of it and all that follow."""
    zero = F.struct(F.array().cast("array<struct<depth:bigint,node:bigint," + ",".join(f"{n}:bigint" for n in names) + ">>").alias("done"),
                    *[F.lit(0).cast("long").alias(n) for n in names])

    def add(acc: Column, x: Column) -> Column:
        sums = [(acc[n] + x[n]).alias(n) for n in names]
        return F.struct(F.concat(acc["done"], F.array(F.struct(x["depth"].alias("depth"), x["node"].alias("node"), *sums))).alias("done"), *sums)

    return F.aggregate(F.reverse(path), zero, add)["done"]


def subtree_sums(paths: DataFrame, names: list[str], height: int = BAND, level: int = 0) -> DataFrame:
    """(depth, node, one sum per name) over the subtree of every node, itself included.

    ``paths`` is a stored table with a row per (conv_id, depth) from 0 to the conversation's end: ``node``, the smallest
    conversation with the same prefix, and the node's own values, which count where ``node`` is ``conv_id``. Only
    conversations that own a node are needed, with their whole paths.

    Within a band, each conversation adds the values of the nodes it owns to those above them, one row per depth. If there
    is more than one band, the totals of the bands' roots are summed over the trie of roots by the same function; then
    each root gives its whole total to its ancestors in the band above. A node is copied at most ``height`` times a
    level, and levels grow with the logarithm of the depth.
    """
    deepest = paths.agg(F.max("depth")).first()[0]
    sums = [F.sum(n).alias(n) for n in names]
    inside = _bands(paths, height, names).select(F.explode(_from_below(F.col("path"), names)).alias("x")).select("x.*").where(
        " or ".join(f"{n} <> 0" for n in names))
    own = paths.where("node = conv_id").select("depth", "node", *[F.lit(0).cast("long").alias(n) for n in names])
    if deepest is None or deepest < height:
        return own.unionByName(inside).groupBy("depth", "node").agg(*sums)
    inside, _ = store(own.unionByName(inside).groupBy("depth", "node").agg(*sums), f"band-{level}")
    roots = paths.where(F.col("depth") % height == 0).select("conv_id", (F.col("depth") / height).cast("long").alias("depth"), "node")
    totals = inside.where(F.col("depth") % height == 0).select((F.col("depth") / height).cast("long").alias("depth"), "node", *names)
    owners = roots.where("node = conv_id").select("conv_id").distinct()
    roots, _ = store(roots.join(owners, "conv_id", "left_semi").join(totals, ["depth", "node"], "left"), f"roots-{level}")
    whole = subtree_sums(roots, names, height, level + 1)
    # A band's root hands its whole total to the nodes of the band above on its own path.
    handed = whole.where("depth > 0").select(F.col("node").alias("conv_id"), (F.col("depth") - 1).alias("band"), *names)
    above = paths.select("conv_id", "depth", "node", F.floor(F.col("depth") / height).alias("band")).join(handed, ["conv_id", "band"]).select("depth", "node", *names)
    return inside.unionByName(above).groupBy("depth", "node").agg(*sums)


def _list_digests(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ends_sha256): the SHA-256 of the members' ids, ascending, comma-joined.

    Ids are put together in parts of at most ``IDS`` neighbouring numbers. Lists of one part are done then. The digest of
    a longer one depends on all that went before, so its parts stream through one task in order; nothing is gathered.
    """
    part = F.floor(F.col("conv_id") / IDS)
    text = F.array_join(F.transform(F.array_sort(F.collect_set("conv_id")), lambda c: c.cast("string")), ",")
    parts = members.groupBy(*keys, part.alias("part")).agg(text.alias("ids"))
    parts, _ = store(parts, "ends")
    again = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again, seen = store(again, "long-lists", {"n": F.count(F.lit(1))})
    single = parts.join(again, keys, "left_anti").select(*keys, F.sha2("ids", 256).alias("ends_sha256"))
    if not seen["n"]:
        return single

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                now = tuple(row[k] for k in keys)
                if now != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(row["ids"].encode())
            yield _rows(done)
        yield _rows([(*key, state.hexdigest())] if key is not None else [])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * (len(keys) + 1)
        kinds = [pa.int64()] * len(keys) + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [*keys, "ends_sha256"])

    long_ = parts.join(again, keys, "left_semi").repartition(*keys).sortWithinPartitions(*keys, "part")
    return single.unionByName(long_.mapInArrow(task, ", ".join(f"{k} long" for k in keys) + ", ends_sha256 string"))


def prefix_trie(chats: DataFrame, height: int = BAND) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per trie node.

    Conversations are rebuilt first, see :func:`rebuilt`. A node of depth d is a distinct sequence of first d (role, text);
    ``conv_id`` is its smallest member, ``parent_conv_id`` that of the node above (the root has none). ``n_leaves`` counts
    the childless nodes of its subtree, itself included, and ``saved_tokens`` adds (members - 1) times the code points of
    the last text over it. ``ends_sha256`` is of the ids of the members that have d turns.

    A null role or text is an empty one; turns are ordered by (turn, role, text), nulls first, and repeated rows are turns
    of their own. Rows without conv_id belong to no conversation and are left out. An empty table has no nodes, not even
    a root. Further columns are not read. Conversations of any length are cut to parts in every step; common first turns
    are met by aggregates and by joins whose one side is unique, which Spark can split.
    """
    with scratch(chats.sparkSession) as kept:
        turns, _ = store(ordered_turns(chats), "ordered")
        turns, each = rebuilt(turns)
        prefix, _ = store(prefixes(turns), "prefixes")
        node, _ = store(prefix.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars")), "nodes")
        whole = each.agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n")).first()
        root = F.lit(whole["node"]).cast("long")
        path, _ = store(prefix.drop("chars").join(node, ["depth", "a", "b"]).select("conv_id", "depth", "node", "n_convs", "chars"), "paths")

        begin = each.where(root.isNotNull()).select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("node"), F.lit(whole["n"]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("chars"))
        path = begin.unionByName(path)
        above = path.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
        nodes, _ = store(path.where("node = conv_id").join(above, ["conv_id", "depth"], "left"), "owned")
        children = nodes.groupBy("parent_conv_id", (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
        children = children.where("parent_conv_id is not null").withColumnRenamed("parent_conv_id", "node")
        nodes, _ = store(nodes.join(children, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "children")

        own = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
        owners = nodes.select("conv_id").distinct()
        paths, _ = store(path.select("conv_id", "depth", "node").join(owners, "conv_id", "left_semi").join(own, ["conv_id", "depth"], "left"), "valued")
        sums = subtree_sums(paths, ["n_leaves", "saved_tokens"], height)

        ends = path.join(each.select("conv_id", F.col("turns").alias("depth")), ["conv_id", "depth"], "left_semi")
        digests = _list_digests(ends, ["depth", "node"])
        result = nodes.join(sums, ["depth", "node"]).join(digests, ["depth", "node"], "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
        result, seen = store(result, "trie")
        kept.append(seen["path"])
    return result
