"""Benchmark passages in training text, by a positional inverted index in a table.

Postings (term, doc_id, pos) of the test items' terms are stored for the whole corpus. Each window of an item is looked
up by its rarest terms: their postings, moved by the term's place in the item, must meet at one offset. Only where they
do are the postings of the window's other terms intersected, again at that offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from airq.llm.common import keyed, only, scratch, store, unkeyed

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: Column) -> Column:
    """A-Z in lower case; the fast function where the text has no other letters to change."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _parts(text: str = "text") -> Column:
    return F.split(_lowered(F.coalesce(F.col(text), F.lit(""))), NOT_WORD, -1)


def _blank(parts: Column, at: int) -> Column:
    return (F.element_at(parts, at) == "").cast("int")


def count_words(parts: Column) -> Column:
    """Words among parts, of which only the first and the last can be empty."""
    return F.greatest(F.size(parts) - _blank(parts, 1) - _blank(parts, -1), F.lit(0)).cast("long")


def postings(texts: DataFrame, key: str) -> DataFrame:
    """(key, pos, term) of every word of ``texts`` (key, text); positions from 0."""
    parts = texts.select(key, _parts().alias("parts"))
    return parts.select(key, _blank(F.col("parts"), 1).alias("skip"), F.posexplode("parts").alias("at", "term")).where(
        "term <> ''").select(key, (F.col("at") - F.col("skip")).alias("pos"), "term")


def phrase_matches(index: DataFrame, items: DataFrame, window: int = 13, rarest: int = 2, slop: int = 0) -> DataFrame:
    """(doc_id, item_id, pos, item_pos): document words in an occurrence of a window of an item.

    ``index`` holds postings (doc_id, pos, term) of at least the items' terms, ``items`` those of the items (item_id,
    pos, term). A window is ``window`` consecutive words of an item, or the item if it is shorter. With ``slop`` 0 the
    words must be the document's in the same places (phrase match); with more, each word may stand up to ``slop`` words
    away from its place (proximity match), and only the rarest term fixes the offset.
    """
    rarest = rarest if slop == 0 else 1
    counts, _ = store(index.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-counts")
    words = items.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    of_item, ahead = Window.partitionBy("item_id"), Window.partitionBy("item_id").orderBy("item_pos").rowsBetween(0, window - 1)
    words = words.withColumnRenamed("pos", "item_pos").withColumn("width", F.least(F.count(F.lit(1)).over(of_item), F.lit(window)))
    begins = words.withColumns({"held": F.collect_list(F.struct("n", "item_pos", "term")).over(ahead)}).where(
        (F.size("held") == F.col("width")) & (F.array_min("held")["n"] > 0))
    windows, _ = store(begins.select("item_id", F.col("item_pos").alias("begin"), "width", F.array_sort("held").alias("held")), "windows")

    # Offsets at which the rarest terms of a window meet.
    anchors = windows.select("item_id", F.explode(F.slice("held", 1, rarest)).alias("a")).select("item_id", "a.term", "a.item_pos").distinct()
    meets = index.join(anchors, "term").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("offset"), "item_pos")
    seen = meets.groupBy("doc_id", "item_id", "offset").agg(F.collect_set("item_pos").alias("met"))
    asked = windows.select("item_id", "begin", "width", F.transform(F.slice("held", 1, rarest), lambda a: a["item_pos"]).alias("need"))
    lone = F.element_at("need", 1)
    first = asked.groupBy("item_id", lone.alias("lone")).agg(F.collect_list(F.struct("begin", "need")).alias("begins"))
    at = seen.select("doc_id", "item_id", "offset", "met", F.explode("met").alias("lone")).join(first, ["item_id", "lone"])
    fits = F.filter("begins", lambda b: F.size(F.array_except(b["need"], F.col("met"))) == 0)
    found, _ = store(at.select("doc_id", "item_id", "offset", F.explode(fits).alias("b")).select("doc_id", "item_id", "offset", "b.begin"), "meets")

    # The other terms at those offsets.
    held = windows.select("item_id", "begin", "width", F.explode("held").alias("h")).select("item_id", "begin", "width", "h.term", "h.item_pos")
    need = found.join(held, ["item_id", "begin"]).select("doc_id", "item_id", "offset", "width", "term", "item_pos").distinct()
    if slop:
        need = need.withColumn("by", F.explode(F.sequence(F.lit(-slop), F.lit(slop))))
    else:
        need = need.withColumn("by", F.lit(0))
    need = need.withColumn("pos", (F.col("offset") + F.col("item_pos") + F.col("by")).cast("int"))
    ids, _ = store(found.select("doc_id").distinct(), "docs-met")
    equal = only(index, ids).join(need, ["doc_id", "pos", "term"]).groupBy("doc_id", "item_id", "offset", "item_pos", "width").agg(
        F.min(F.struct(F.abs("by").alias("far"), "pos"))["pos"].alias("pos"))
    # Consecutive item words that all match are windows where there are enough of them.
    line = Window.partitionBy("doc_id", "item_id", "offset").orderBy("item_pos")
    runs = equal.withColumn("run", F.col("item_pos") - F.row_number().over(line))
    return runs.withColumn("long", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "item_id", "offset", "run"))).where(
        "long >= width").select("doc_id", "item_id", "pos", "item_pos")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, slop: int = 0) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated), one row per doc_id.

    Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` with A-Z in lower case. ``n_hit`` counts the document's
    words inside any occurrence of a window, ``items`` are the ids, as sorted strings, of the items with an occurring
    window, and a document is contaminated if n_hit > 0 and share * n_hit >= n_words.

    Null and empty texts have no words; items without words match nothing. Repeated doc_ids and item_ids count as one
    document or item (see :func:`airq.llm.common.one_per_id`); a null doc_id is one, and a null item_id is the text
    ``null``. Further columns are not read.
    """
    docs = keyed(docs)
    with scratch(docs.sparkSession) as kept:
        items, _ = store(postings(_items(benchmark), "item_id"), "items")
        terms, _ = store(items.select("term").distinct(), "terms")
        index, _ = store(postings(docs, "doc_id").join(terms, "term", "left_semi"), "postings")
        hits = phrase_matches(index, items, window, slop=slop)
        of_doc, seen = store(hits.groupBy("doc_id").agg(
            F.countDistinct("pos").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items")), "hits")
        kept.append(seen["path"])
    rows = docs.select("doc_id", count_words(_parts()).alias("n_words")).join(of_doc, "doc_id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    found = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(unkeyed(), "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), found.alias("items"),
                       ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id string, text), one row per item."""
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    return named.groupBy("item_id").agg(F.max("text").alias("text"))
