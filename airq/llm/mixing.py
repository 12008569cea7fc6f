"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from airq.llm.common import SPACES, scratch, store
from airq.llm.numbering import numbered

#: Words of a block, the unit in which sources get their quotas.
BLOCK = 16
#: Words and documents of a shard, at most about; a source has as many shards as it needs.
SHARD_WORDS, SHARD_ROWS = 1 << 22, 1 << 10
#: Multiplier of the order of blocks, a prime above the blocks of any shard, and the bits of a document's hash.
STEP, HASH_DIGITS = 1_640_531_513, 15


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^" + SPACES[1:])), F.lit(0)).cast("long")


def seeded(seed: int, key: Column) -> Column:
    """60 bits of a digest of the seed and the key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("long")


def apportioned(rows: DataFrame, group: str, share: str, seats: str, name: str) -> DataFrame:
    """``rows`` with ``won``: of its group's ``seats`` those with the highest quotients share / 1, share / 3, share / 5, ...

    ``rows`` has one row per (``group``, ``id``), neither null, and the same number of seats throughout a group; equal
    quotients go to the smaller id. With n rows in a group a divisor of total / (seats - n / 2) gives no seat too many and
    one of total / (seats + n / 2) none too few, so only the seats between, 4 n at most, are ranked. The rank comes from
    range partitions, so a group can have any number of rows.
    """
    total, _ = store(rows.groupBy(group).agg(F.sum(share).alias("_total"), F.count(F.lit(1)).alias("_n")), f"{name}-totals")

    def by(votes: Column) -> Column:
        return F.when((F.col("_total") > 0) & (votes > 0), F.floor(F.col(share) * votes / F.col("_total") + 0.5)).otherwise(F.lit(0))

    sure = F.greatest(by(F.col(seats) - F.col("_n") / 2) - 1, F.lit(0))
    most = F.when((F.col(share) > 0) & (F.col(seats) > 0), by(F.col(seats) + F.col("_n") / 2) + 1).otherwise(F.lit(0))
    x, _ = store(rows.join(total, group).withColumn("_sure", sure.cast("long")).withColumn("_most", most.cast("long")).drop("_total", "_n"), f"{name}-sure")
    open_ = x.where("_most > _sure").select(group, "id", F.col(share).alias("_share"), F.explode(F.sequence("_sure", F.col("_most") - 1)).alias("_k"))
    ranked = numbered(open_.withColumn("_quotient", F.col("_share") / (2 * F.col("_k") + 1)), [F.col(group).asc(), F.col("_quotient").desc(), F.col("id").asc(), F.col("_k").asc()],
                      f"{name}-seats")
    left = x.groupBy(group).agg((F.max(seats) - F.sum("_sure")).alias("_left"))
    first = ranked.groupBy(group).agg(F.min("position").alias("_first"))
    limits, _ = store(left.join(first, group).select(group, (F.col("_first") + F.col("_left")).alias("_until")), f"{name}-limits")
    won = ranked.join(limits, group).where("position < _until").groupBy(group, "id").agg(F.count(F.lit(1)).alias("_more"))
    return x.join(store(won, f"{name}-won")[0], [group, "id"], "left").withColumn("won", F.col("_sure") + F.coalesce("_more", F.lit(0))).drop("_more", "_sure", "_most")


def _targets(sources: DataFrame, most: int) -> tuple[DataFrame, int]:
    """``sources`` (source, words, weight) with ``target``, and the number of all words.

    All words are shared out by weight; a target stops at ``most`` times its source's words, and what is left over goes
    to the others by weight, until none is above. Each round needs three sums, and only adds sources at their limit.
    """
    total = sources.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    cap = F.col("words") * most
    rest, weights, full = total, None, F.lit(False)
    while True:
        seen = sources.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("full"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open")).first()
        if (seen["open"], total - seen["full"]) == (weights, rest) or not seen["open"]:
            break
        rest, weights = total - seen["full"], seen["open"]
        # By integers, so that every round and every engine cuts alike.
        full = full | (F.col("weight").cast("decimal(38,0)") * F.lit(rest).cast("decimal(20,0)") > cap.cast("decimal(38,0)") * F.lit(weights).cast("decimal(20,0)"))
    part = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(weights or 1))
    return sources.withColumn("target", F.when(full | F.lit(not weights), cap.cast("double")).otherwise(part)), total


def mix_sources(docs: DataFrame, weights: Sequence[int] | DataFrame = (5, 2, 1), most: int = 3, block: int = BLOCK, seed: int = 13,
                shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, shard, passes, spans, taken), one row per row of ``docs``.

    ``size`` counts the words of the text, ``source_size`` those of its source. Sources in order of code points, null
    last, weigh ``weights`` in turn; or ``weights`` has rows (source, weight) of positive integers, and sources that it
    does not name get nothing. Together the targets are as many words as there are; none is more than ``most`` times its
    source. Equal blocks of ``block`` words go to the sources by the highest quotients of the targets, then to the shards
    of each source by those of the shards' words. In a shard, documents lie one after another in the order of their
    seeded hashes; its quota takes whole passes over the shard, and of the pass that is left the blocks that a seeded
    order names first, the last of them in part, so that exactly the quota is taken. ``passes`` says how often all words
    of a document are taken, ``spans`` (start, length) the words taken once more, ``taken`` counts both.

    No word is taken more than ``most`` times. Rows with one doc_id are documents of their own and are told apart by
    their size; null and empty texts have size 0 and take nothing; rows that are equal in doc_id and size can change
    places. A null doc_id hashes like any other. An empty table gives no rows. Further columns are not read. A source can
    hold most rows: its shards are bounded in words and rows, but for a single longer text.
    """
    with scratch(docs.sparkSession) as kept:
        sizes, _ = store(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
        found = sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        found = numbered(found, [F.col("source").asc_nulls_last()], "sources").withColumnRenamed("position", "sid")
        if isinstance(weights, DataFrame):
            named = weights.select(F.col("source").alias("_source"), F.col("weight").cast("long").alias("weight"))
            found = found.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").withColumn("weight", F.coalesce("weight", F.lit(0)))
        else:
            found = found.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("long"))
        # Stored with the one group of all sources, so that the optimizer sees a key to join on.
        found, total = _targets(store(found.withColumn("mix", F.lit(0)), "weighed")[0], most)
        sources = apportioned(found.withColumn("id", F.col("sid")).withColumn("seats", F.lit((2 * total + block) // (2 * block)).cast("long")),
                              "mix", "target", "seats", "mix")
        shards = F.greatest(F.ceil(F.col("words") / shard_words), F.ceil(F.col("n") / shard_rows), F.lit(1)).cast("long")
        sources, _ = store(sources.select("sid", F.col("source").alias("_source"), F.col("words").alias("source_size"), "target", F.col("won").alias("blocks"), shards.alias("shards")), "quotas")

        dealt = sizes.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("hash", seeded(seed, F.col("doc_id"))).withColumn(
            "shard", F.pmod(F.col("hash"), F.col("shards")))
        lines, _ = store(dealt.groupBy("sid", "shard").agg(F.sum("size").alias("line"), F.max("blocks").alias("seats")).withColumn("id", F.col("shard")), "lines")
        quota = F.least(F.col("won") * block, F.col("line") * most)
        lines, _ = store(apportioned(lines, "sid", "line", "seats", "shards").select("sid", "shard", "line", quota.alias("quota")), "shards")

        order = Window.partitionBy("sid", "shard").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = dealt.withColumn("begin", F.sum("size").over(order) - F.col("size")).join(lines, ["sid", "shard"])
        passes = F.when(F.col("line") > 0, F.floor(F.col("quota") / F.col("line"))).otherwise(F.lit(0)).cast("long")
        placed = placed.withColumn("passes", passes).withColumn("more", F.col("quota") - F.col("passes") * F.col("line")).withColumn("spans", _spans(block, seed))
        taken = F.col("passes") * F.col("size") + F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
        result, seen = store(placed.select("doc_id", "source", "size", "source_size", "target", "shard", "passes", "spans", taken.alias("taken")), "mixed")
        kept.append(seen["path"])
    return result


def _spans(block: int, seed: int) -> Column:
    """Words of a document, as (start, length), in the blocks that make up ``more`` words of its shard's line.

    The line's whole blocks are taken in the order of (number * STEP + seed) modulo their count, what is beyond them last.
    """
    begin, size, more = F.col("begin"), F.col("size"), F.col("more")
    whole = F.floor(F.col("line") / block)

    def span(k: Column) -> Column:
        turn = F.when(k < whole, F.pmod(k * STEP + seed, F.greatest(whole, F.lit(1)))).otherwise(whole)
        until = F.least(k * block + F.greatest(F.least(more - turn * block, F.lit(block)), F.lit(0)), begin + size)
        start = F.greatest(k * block, begin)
        return F.struct((start - begin).cast("long").alias("start"), (until - start).cast("long").alias("length"))

    numbers = F.sequence(F.floor(begin / block), F.floor((begin + size - 1) / block))
    spans = F.filter(F.transform(numbers, span), lambda s: s["length"] > 0)
    return F.when((size > 0) & (more > 0), spans).otherwise(F.array().cast("array<struct<start:bigint,length:bigint>>"))
