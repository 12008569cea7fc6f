"""Chat formatting, WARC archives and packing."""

from __future__ import annotations

import zlib

import brute
import pytest
from pyspark.sql import functions as F

from airq.llm.chat_format import Template, format_chats, read_back
from airq.llm.packing import fill, pack
from airq.llm.warc_zstd import frames, parse_record, read_archives, resolved, train_dictionary, write_archives

SF = "/root/testdata/sf0.001"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
CHATS = "conv_id long, turn long, role string, text string, valid string, formatted int"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], CHATS)


def test_chats_round_trip(spark):
    rows = [(1, 0, "system", "a␛b ␛. ␛␛"), (1, 1, "user", "<|tu<|turn|>rn|><s><s>[INST]"), (1, 2, "assistant", "ok</s>␛"),
            (2, 1, "assistant", None), (2, 0, None, "x"), (3, None, "user", ""), (3, None, "user", ""), (None, 0, "user", "hi"),
            (4, 0, "user", "é😀" * 50_000), (4, 1, "assistant", "fine"), (5, 0, "us<|text|>er", "<|end|>")]
    out = format_chats(chats(spark, rows)).cache()
    got = {r.conv_id: r for r in out.collect()}
    assert got[1].valid and got[4].valid and not got[2].valid and not got[3].valid and not got[None].valid
    assert (got[1].n_legal, got[2].n_legal, got[3].n_legal, got[None].n_legal) == (3, 0, 1, 1)
    t = Template()
    for r in got.values():
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.formatted.count(t.turn) == r.formatted.count(t.end) == r.n_turns
        assert not any(c in s.text for s in r.segments[1::3] for c in t.controls)
    back = {r.conv_id: r for r in read_back(out).collect()}
    assert [tuple(x) for x in back[1].turns] == [(r[2], r[3]) for r in rows[:3]] and back[1].loss_text == "ok</s>␛"
    assert [tuple(x) for x in back[2].turns] == [("", "x"), ("assistant", "")] and back[2].loss_text == ""
    assert [tuple(x) for x in back[5].turns] == [("us<|text|>er", "<|end|>")]
    assert back[4].turns[0].text == "é😀" * 50_000
    assert format_chats(chats(spark, [])).count() == 0
    out.unpersist()


def test_long_conversation(spark):
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(1_500)]
    one = format_chats(chats(spark, rows).repartition(5)).first()
    assert one.valid and one.n_turns == one.n_legal == 1_500
    assert [s.text for s in one.segments if s.loss] == [f"t{i}" for i in range(1, 1_500, 2)]


def test_template_refuses_bad_controls():
    with pytest.raises(ValueError):
        Template(turn="␛x")


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n int")


def test_warc_round_trip(spark):
    same = "z" * 100
    rows = [(3, "http://a/ü\n", same), (1, None, same), (2, "u", same[:99]), (4, "u", same[:99]), (5, "u", None), (6, "u", ""),
            (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n" + "é" * 400_000), (8, "u", same), (8, "u", same), (None, "n", "x")]
    archives = write_archives(pages(spark, rows).repartition(2), b"").cache()
    records = {r.page_id: r for r in read_archives(archives).collect()}
    assert all(r.problem is None for r in records.values())
    assert records[3].uri == "http://a/ü\n" and records[1].uri is None and bytes(records[7].payload).decode() == rows[6][2]
    got = {r.page_id: tuple(r)[1:] for r in resolved(read_archives(archives)).collect()}
    sha = brute.sha
    assert got == {1: (100, sha(same), "response", None, None), 3: (100, sha(same), "revisit", 1, None), 8: (100, sha(same), "revisit", 1, None),
                   2: (99, sha(same[:99]), "response", None, None), 4: (99, sha(same[:99]), "response", None, None),
                   5: (0, sha(""), "response", None, None), 6: (0, sha(""), "response", None, None),
                   7: (800_016, sha(rows[6][2]), "response", None, None), None: (1, sha("x"), "response", None, None)}
    assert write_archives(pages(spark, []), b"").count() == 0
    archives.unpersist()


def test_warc_dictionary_and_damage(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    dictionary = train_dictionary(table)
    assert len(dictionary) > 1_000
    content = bytes(write_archives(table.limit(20).coalesce(1), dictionary).first().content)
    whole = list(frames(content))
    assert len(whole) == 20 and all(parse_record(r)["problem"] is None for r in whole)
    bad = bytearray(content)
    bad[-20] ^= 255
    with pytest.raises(ValueError):
        list(frames(bytes(bad)))
    with pytest.raises(ValueError):
        list(frames(content[:-3]))
    with pytest.raises(ValueError):
        list(frames(b"plain"))
    assert parse_record(whole[0].replace(b"Content-Length: ", b"Content-Length: 1", 1))["problem"]
    assert parse_record(b"nothing")["problem"] == "no WARC header"
    assert parse_record(whole[0].replace(b"<p>", b"<q>"))["problem"] == "the payload is not that of its header"
    rows = spark.createDataFrame([(bytearray(content[:-3]),), (None,), (bytearray(b""),)], "content binary")
    assert sorted(r.problem for r in read_archives(rows).where("problem is not null").collect()) == ["frame breaks off", "no dictionary frame"]


def test_pack_is_exact(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(TOKENIZER)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900, None), (901, ""), (None, "null id"), (902, "<|endoftext|> a\r\n \t é😀"), (903, "w " * 40_000), (903, "w " * 40_000)],
                                "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(odd)
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    ids = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for k, t in texts.items()}
    pieces = pack(rows.withColumn("length", F.lit(1)).repartition(4), TOKENIZER, shard=64).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        own = ids[p.doc_id][p.start:p.start + p.length]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))
        assert (p.ids_crc32, p.doc_tokens, len(own)) == (crc, len(ids[p.doc_id]), p.length)
    assert set(by_doc) == set(ids)
    for k, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[k])
    short = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        short += at < 1024
    assert short <= 8
    assert pack(rows.limit(0), TOKENIZER).count() == 0


def test_fill_takes_neighbours():
    import numpy as np
    a, b = np.arange(10, dtype="<u4"), np.arange(100, 110, dtype="<u4")
    out = list(fill([a, b, a, b], 20))
    assert out == [[(0, 0, 10), (2, 0, 10)], [(1, 0, 10), (3, 0, 10)]]
    assert list(fill([], 20)) == []
    assert list(fill([a, a, a], 16)) == [[(0, 0, 10), (1, 0, 6)], [(1, 6, 4), (2, 0, 10)]]


def test_pack_seeks_neighbours_in_the_whole_corpus(spark):
    """Forty topics with words of their own, far more documents than a shard holds."""
    import random
    draw = random.Random(3)
    topics = [[f"{draw.choice('bdfgklmnprstvz')}{draw.choice('aeiou')}{draw.randrange(10_000)}" for _ in range(40)] for _ in range(40)]
    rows = [(i, " ".join(draw.choices(topics[i % 40], k=30))) for i in range(1_600)]
    pieces = pack(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER, shard=160).orderBy("sequence_id", "offset").collect()
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert len({p.sequence_id >> 32 for p in pieces}) >= 8
    pairs = [(a.doc_id % 40, b.doc_id % 40) for a, b in zip(pieces, pieces[1:]) if a.sequence_id == b.sequence_id]
    assert sum(a == b for a, b in pairs) > 0.7 * len(pairs)


def test_neighbours_are_those_of_all_terms():
    """Against plain BM25 over every term of the seed, with frequent and rare terms."""
    import numpy as np
    from airq.llm.packing import Index, corpus_of
    draw = np.random.default_rng(1)
    texts = [(draw.zipf(1.3, 120) % 900).astype("<u4") for _ in range(80)]
    corpus = corpus_of(texts)
    score = np.zeros(80)
    for i, text in enumerate(texts):
        terms, often = np.unique(text, return_counts=True)
        shared = np.isin(terms, texts[7])
        score[i] = corpus.weights(terms[shared], often[shared], len(text)).sum()
    got = list(Index(texts).neighbours(7))
    assert len(got) == (score > 0).sum() and np.allclose(score[got], np.sort(score[score > 0])[::-1])


def test_sample_of_the_tree_is_bounded():
    """However many documents there are, about 65,536 sketches reach the driver, and the tree has at most 2,048 leaves."""
    from airq.llm import packing
    for n in (3_000, 100_000, 4_200_000, 15_000_000, 10 ** 9, 10 ** 12):
        assert n / packing.sample_rate(n) <= packing.SKETCHES
    assert packing.sample_rate(100_000) == packing.ONE_OF and packing.LEAVES * 32 <= packing.SKETCHES


def test_statistics_count_whole_documents(spark):
    from airq.llm.packing import corpus_statistics, tokenized
    texts = ["one two three", "two " * 40, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tokenizer = "/opt/tokenizers/byte_bpe_50k.json"
    pieces = tokenized(docs, tokenizer, 8).cache()
    from tokenizers import Tokenizer
    plain = [{*Tokenizer.from_file(tokenizer).encode(t or "", add_special_tokens=False).ids, 0} for t in texts]
    corpus = corpus_statistics(pieces, 4, 100)
    import numpy as np
    held = np.array([sum(t in p for p in plain) for t in range(len(corpus.idf))])
    assert np.allclose(corpus.idf, np.log1p((4 - held + 0.5) / (held + 0.5)))


def test_shards_beyond_the_leaves(spark, monkeypatch):
    from airq.llm import packing
    monkeypatch.setattr(packing, "LEAVES", 2)
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} common word {i}") for i in range(300)], "doc_id long, text string")
    rows = pack(docs, "/opt/tokenizers/byte_bpe_50k.json", window=32, shard=40).collect()
    ids = {r.doc_id: 0 for r in rows}
    for r in rows:
        ids[r.doc_id] += r.length
    assert len(ids) == 300 and all(ids[r.doc_id] == r.doc_tokens for r in rows)
    assert len({r.sequence_id >> 32 for r in rows if r.sequence_id % 2 == 0}) > 2
