"""Decontamination, substring dedup, toxicity, ordinal quality and fertility rules."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import brute
import numpy as np
import pytest

from airq.llm import ordinal_quality, toxicity
from airq.llm.decontaminate import contamination, phrase_matches, postings
from airq.llm.fertility import fertility_rules
from airq.llm.ordinal_quality import grade_quality
from airq.llm.substring_dedup import remove_repeats, repeated_paths
from airq.llm.toxicity import score_toxicity

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
DOCS = "doc_id long, text string, lang string, term string, pos int"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "xx", "t", 1) for r in rows], DOCS).repartition(parts)


# -- decontamination

def contaminated(texts, items, window=13):
    split = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(brute.LOWER))
    needles = {}
    for i, t in items.items():
        w = split(t)
        n = min(window, len(w))
        for b in range(len(w) - n + 1 if n else 0):
            needles.setdefault(tuple(w[b:b + n]), set()).add(i)
    out = {}
    for k, t in texts.items():
        w, hit, ids = split(t), set(), set()
        for n in {len(x) for x in needles}:
            for b in range(len(w) - n + 1):
                found = needles.get(tuple(w[b:b + n]))
                if found:
                    hit |= set(range(b, b + n))
                    ids |= found
        out[k] = (len(w), len(hit), len(ids), sorted(ids), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_contamination_matches_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "a", "é1", "b", "cc"])
    items = {str(i): " ".join(word() for _ in range(rng.choice([1, 3, 12, 13, 14, 40]))) for i in range(25)} | {"x": "", "y": None, "z": "--"}
    texts = {i: " ".join(word() for _ in range(rng.choice([0, 1, 5, 60, 300]))) for i in range(60)}
    for i in range(60, 75):
        texts[i] = " ".join("w%d" % rng.randrange(500) for _ in range(80)) + ". " + (items[str(i % 25)] or "").upper() + "!" + texts[i - 50]
    texts |= {100: None, 101: "", 102: "-- !!", 103: "Zz " * 100_000, -1: (items["3"] + " ") * 50}
    bench = spark.createDataFrame([(k, t, 1) for k, t in items.items()] + [("3", items["3"], 1)], "item_id string, text string, doc_id int")
    rows = docs(spark, [*texts.items(), (103, texts[103]), (None, items["5"])])
    got = {r.doc_id: tuple(r)[1:] for r in contamination(rows, bench).collect()}
    assert got.pop(None)[4]
    assert got == contaminated(texts, items)
    assert contamination(rows.limit(0), bench).count() == 0
    assert {r.n_items for r in contamination(rows, bench.limit(0)).collect()} == {0}


def test_proximity_matches(spark):
    item = [f"w{i}" for i in range(13)]
    moved = [*item[:6], "extra", *item[6:]]
    index = postings(docs(spark, [(1, " ".join(moved)), (2, " ".join(item)), (3, "w0 w1 w2")]).select("doc_id", "text"), "doc_id")
    asked = postings(spark.createDataFrame([("i", " ".join(item))], "item_id string, text string"), "item_id")
    found = lambda slop: Counter(r.doc_id for r in phrase_matches(index, asked, slop=slop).collect())
    assert found(0) == {2: 13} and found(1) == {1: 13, 2: 13}


# -- substring dedup

def without_repeats(texts, span):
    seen, out = set(), {}
    for k in sorted(texts, key=lambda k: (k is not None, k)):
        w = brute.SPACE_WORD.findall(texts[k] or "")
        gone = set()
        for b in range(len(w) - span + 1):
            key = tuple(w[b:b + span])
            if key in seen:
                gone |= set(range(b, b + span))
            seen.add(key)
        out[k] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_repeats_match_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [" ".join("p%d" % rng.randrange(10**6) for _ in range(rng.choice([20, 21, 60]))) for _ in range(6)]
    texts = {}
    for i in range(120):
        parts = [" ".join("w%d" % rng.randrange(3000) for _ in range(rng.randrange(40))) for _ in range(3)]
        parts.insert(1, rng.choice(passages)[rng.randrange(3) * 8:])
        texts[i * 7 % 121] = "\n".join(parts)
    texts |= {200: "a " * 300, 201: "a " * 30, 202: None, 203: "", 204: texts[3], 205: "one two", 206: "one two", 207: "b  c\t" * 20_000, None: passages[0]}
    rows = docs(spark, [*texts.items(), (205, "one two")])
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(rows).collect()}
    assert got == without_repeats(texts, 20)
    assert remove_repeats(rows.limit(0)).count() == 0


def test_paths_name_their_source(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    paths, copies = repeated_paths(docs(spark, [(1, f"a b {passage} c"), (2, f"x {passage}"), (3, f"x {passage}")]), 20)
    assert [tuple(r) for r in paths.collect()] == [(2, 1, 11, 1, 2)] and [r.doc_id for r in copies.collect()] == [3]


def test_hot_edges_take_the_other_way(spark, monkeypatch):
    from airq.llm import substring_dedup
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = {i: f"a{i} {passage} b{i}" for i in range(12)}
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(docs(spark, texts.items())).collect()}
    assert got == without_repeats(texts, 20)


# -- classifiers

def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    labels = np.array(labels)
    n = labels.sum()
    return (order[labels == 1].sum() - n * (n - 1) / 2) / (n * (len(labels) - n))


def test_toxicity(spark):
    rng = random.Random(1)
    stems = ["ba", "ko", "ri", "ten", "sul", "mor", "vi", "lan"]
    word = lambda: "".join(rng.choice(stems) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(1_200):
        words = [word() for _ in range(rng.randrange(20, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["wretchzq", "fyxhuman", "dumqloth"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(5_000, None), (5_001, ""), (5_002, "ba " * 100_000), (None, "wretchzq fyxhuman dumqloth " * 20), (5_003, "x"), (5_003, "x")]
    marks = spark.createDataFrame([*labels, (None, 1), (9_999, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(docs(spark, rows), marks).collect()}
    assert len(got) == 1_205 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    out = [(got[i].score, t) for i, t in labels if got[i].held_out]
    assert 300 < len(out) < 500 and auc(*zip(*out)) > 0.97
    assert got[None].predicted == 1 and not got[None].held_out and got[5_000].predicted == got[5_001].predicted == 0
    assert {r.score for r in score_toxicity(docs(spark, rows[:5]), marks.limit(0)).collect()} == {0.0}
    assert score_toxicity(docs(spark, rows).limit(0), marks).count() == 0


def test_toxicity_does_not_learn_from_held_out_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.withColumn("toxic", (toxicity.held_out() != (labels.toxic == 1)).cast("int"))
    first, second = (score_toxicity(table, x).orderBy("doc_id").toPandas() for x in (labels, turned))
    assert first.equals(second)


def test_ordinal_model_orders_grades():
    rng = random.Random(2)
    texts, grades = [], []
    for _ in range(600):
        g = rng.randrange(4)
        texts.append(" ".join(rng.choice([f"g{g}", "x", "y", "z"]) for _ in range(30)))
        grades.append(g)
    model = ordinal_quality.fit(texts, grades, 3)
    assert (np.diff(model.cuts) > 0).all()
    features = ordinal_quality.featurizer()
    means = [np.mean([model.chances(*features(t)).sum() for t, y in zip(texts, grades) if y == g]) for g in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 1.5
    assert all((np.diff(model.chances(*features(t))) <= 0).all() for t in texts[:50])


def test_quality_of_table_and_odd_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    ratings = labels.selectExpr("doc_id", "quality * (2 - toxic) as grade")
    odd = docs(spark, [(90_000, None), (90_001, ""), (None, "w " * 100_000), (90_002, "a"), (90_002, "a")]).select("doc_id", "text")
    got = {r.doc_id: r for r in grade_quality(table.select("doc_id", "text").union(odd), ratings, 2).collect()}
    assert len(got) == 1_004 and all(0 <= r.expected_grade <= 2 and r.kept == (r.tail >= 0.5) for r in got.values())
    held = [(got[r.doc_id].tail, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert auc(*zip(*held)) > 0.95
    alone = grade_quality(odd, ratings.limit(0), 2).collect()
    assert len({round(r.expected_grade, 9) for r in alone}) == 1
    assert grade_quality(odd.limit(0), ratings, 2).count() == 0


# -- fertility

def base_counts(text):
    text = text or ""
    w = brute.SPACE_WORD.findall(text)
    lines, met, repeats = text.split("\n"), set(), 0
    for line in lines:
        if brute.SPACE_WORD.search(line):
            repeats += line in met
            met.add(line)
    tri = Counter(zip(w, w[1:], w[2:]))
    cover = {i + j for i, t in enumerate(zip(w, w[1:], w[2:])) if tri[t] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), repeats, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))


def test_fertility_matches_brute_force(spark):
    import sentencepiece
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = docs(spark, [(90_000, None), (90_001, ""), (None, "é😀 日本\n" * 100), (90_002, "# a\nb\n# a\n\n\n x  y\x0b"), (90_002, "# a\nb\n# a\n\n\n x  y\x0b"),
                       (90_003, "q" * 300_000)])
    rows = table.select("doc_id", "text", "lang").union(odd.select("doc_id", "text", "lang"))
    texts = {r.doc_id: r.text for r in rows.collect()}
    got = {r.doc_id: r for r in fertility_rules(rows, VOCABULARY).collect()}
    assert len(got) == len(texts)
    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    for k, t in texts.items():
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(t), k
        w = brute.SPACE_WORD.findall(t or "")
        if w and len(w) < 2_000:
            ids = [i for x in w for i in model.encode(x)]
            p = np.array(list(Counter(ids).values())) / len(ids)
            entropy = -(p * np.log2(p)).sum() / math.log2(len(ids)) if len(ids) > 1 else 1.0
            assert (r.chars_per_token, r.fallback_share, r.entropy) == pytest.approx(
                (sum(map(len, w)) / len(ids), sum(model.IsByte(i) for i in ids) / len(ids), entropy))
        assert not (r.base_failed and r.kept)
    clean = [r for r in got.values() if not r.base_failed]
    assert sum(r.kept for r in clean) > 0.9 * len(clean)
    assert fertility_rules(rows.limit(0), VOCABULARY).count() == 0


def test_fertility_rejects_what_its_language_has_not(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["house", "garden", "running", "water", "people"]) + str(rng.randrange(9)) for _ in range(80))) for i in range(40)]
    rows.append((99, " ".join("".join(chr(0x1D400 + rng.randrange(500)) for _ in range(6)) for _ in range(80))))
    kept = {r.doc_id for r in fertility_rules(docs(spark, rows), VOCABULARY).where("kept").collect()}
    assert kept == set(range(40))
