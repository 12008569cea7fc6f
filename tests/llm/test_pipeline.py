"""The pipeline stage by stage against plain versions, each on what the stage before kept."""

from __future__ import annotations

import brute
import pytest
from test_rules import contaminated

import __spark_entry__ as entry
import corpus_pipeline
from airq.llm.toxicity import score_toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """The smallest table with planted copies, near copies, benchmark text, odd rows and a clashing column."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    words = next(t for k, t in sorted(texts.items()) if len(t.split()) > 150 and "\n" not in t[:400]).split()
    near = [*words]
    near[7] = "changed"
    rows = [(5_000, texts[3]), (5_001, "Start " + " ".join(words)), (5_002, "Start " + " ".join(near)), (5_003, f"Some words here and {item}"),
            (5_004, None), (5_005, ""), (None, "a document without an id")]
    extra = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path_factory.mktemp("docs") / "in")
    table.select(extra.columns).unionByName(extra).write.parquet(path)
    return spark.read.parquet(path)


def test_stages_match_brute_force(spark, docs, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = {str(r.item_id): r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.asDict() for r in docs.collect()}
        texts = {k: r["text"] for k, r in before.items()}
        path = str(tmp_path / name)
        out = stage(spark, docs, SF)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(before)
            break
        assert out.columns == columns
        got = {r.doc_id: r.asDict() for r in out.collect()}
        if name == "toxicity":
            gone = {r.doc_id for r in score_toxicity(docs, labels).where("predicted = 1").collect()}
            want = {k: r for k, r in before.items() if k not in gone}
        elif name == "line_dedup":
            lines = brute.lines({-1 if k is None else k: t for k, t in texts.items()}, 8)
            want = {}
            for k, r in before.items():
                _, text, _, removed = lines[-1 if k is None else k]
                if removed and not brute.SPACE_WORD.search(text):
                    continue
                want[k] = r | ({"text": text, "n_chars": len(text)} if removed else {})
        elif name == "near_dedup":
            near = brute.near({-1 if k is None else k: t for k, t in texts.items()}, 5)
            want = {k: r for k, r in before.items() if near[-1 if k is None else k][3]}
        else:
            bad = contaminated({-1 if k is None else k: t for k, t in texts.items()}, items)
            want = {k: r for k, r in before.items() if not bad[-1 if k is None else k][4]}
            assert 5_003 not in want
        assert got == want, name
        docs = out


@pytest.mark.parametrize("index", range(4))
def test_stages_take_odd_tables(spark, index):
    """Clashing column names, repeated rows, nulls everywhere and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, of string, gone int, cleaned string, count long"
    line = "a line of some length that stands in two documents"
    rows = [(1, f"{line}\nx y z w v u t", "en", "s", 64, "o", 1, "c", 2), (2, line, None, None, None, None, None, None, None), (3, "unlike", "en", "s", 6, "o", 1, "c", 2),
            (3, "unlike", "en", "s", 6, "o", 1, "c", 2), (None, None, None, None, None, None, None, None, None)]
    name, stage = corpus_pipeline.STAGES[index]
    got = stage(spark, spark.createDataFrame(rows, schema), SF).collect()
    want = [tuple(r) for r in rows]
    if name == "line_dedup":
        del want[1]  # nothing is left of it
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    empty = stage(spark, spark.createDataFrame([], schema), SF)
    assert empty.columns == [c.split()[0] for c in schema.split(", ")] and empty.count() == 0


def test_run_is_registered(spark):
    assert entry.queries()["pipeline"](spark, SF).count() > 0
    assert ("pipeline" in entry.oracle_sql()) == (corpus_pipeline.ORACLE_SQL is not None)


def test_one_query_of_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
