from __future__ import annotations

import random

import brute
import pytest
from pyspark.sql import functions as F

from airq.llm.components import components
from airq.llm.line_dedup import dedup_lines
from airq.llm.near_dedup import near_duplicates

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, id string, count int"


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, None, "x", 1) for i, t in texts], DOCS).repartition(parts)


def group(n, words=60, edits=3, seed=1):
    """Near copies of one text, each with its own edits."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(edits):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_components(spark):
    rows = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (None, 4), (21, 20)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}
    chain = spark.range(300).selectExpr("id as u", "id + 1 as v")
    assert {r[1] for r in components(chain).collect()} == {0}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in near_duplicates(docs, shingle=2).collect()}
    assert got == brute.near({r.doc_id: r.text for r in docs.collect()})


def test_near_duplicates_of_a_large_group(spark):
    texts = dict(enumerate(group(300) + ["Foo bar"] * 50 + ["foo BAR", "", "one", " \t\n", "one"]))
    got = {r.doc_id: tuple(r) for r in near_duplicates(frame(spark, texts.items()), shingle=2).collect()}
    assert got == brute.near(texts)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, None), (None, "a b c"), (2, ""), (3, "x " * 200_000), (3, "x " * 200_000), (4, "x x"), (None, None)]
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates(frame(spark, rows), shingle=2).collect()}
    assert got == {1: (0, 1, True), None: (2, None, True), 2: (0, 2, True), 3: (1, 3, True), 4: (1, 3, False)}
    assert near_duplicates(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("size", [8])
def test_lines_match_brute_force(spark, size):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0")
    got = {r.doc_id: tuple(r) for r in dedup_lines(docs, size).collect()}
    want = brute.lines({r.doc_id: r.text for r in docs.collect()}, size)
    wrong = [k for k in want if got[k] != want[k]]
    assert len(got) == len(want) and len(wrong) <= 2, wrong[:5]


def test_lines_of_odd_rows(spark):
    long = "long line number one with several words in it"
    rows = [(5, f"{long}\n\nab\n{long}."), (6, f"  {long}  \nab\nother"), (7, None), (8, ""), (9, "\n\n"), (None, "other"),
            (10, "y" * 300_000), (10, "y" * 300_000)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in dedup_lines(frame(spark, rows)).collect()}
    assert got == {5: (f"{long}\n\nab", 4, 1), 6: ("", 3, 3), 7: (None, 1, 0), 8: ("", 1, 0), 9: ("\n\n", 3, 0),
                   None: ("other", 1, 0), 10: ("y" * 300_000, 1, 0)}
    assert dedup_lines(frame(spark, []).limit(0)).count() == 0


def test_lines_of_a_large_group(spark):
    texts = {i: t for i, t in enumerate(group(200, words=40, edits=1))}
    got = dedup_lines(frame(spark, texts.items())).agg(F.sum("n_removed")).first()[0]
    assert got == 199
