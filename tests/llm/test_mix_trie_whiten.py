"""Mixing and the prefix trie against SQL on odd tables with small parts, whitening against another eigensolver."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from airq.llm import prefix_trie as trie_module, sql
from airq.llm.mixing import apportioned, mix_sources
from airq.llm.numbering import numbered
from airq.llm.prefix_trie import prefix_trie
from airq.llm.whitening import one_sided_jacobi, pivoted_cholesky, whiten

SF = "/root/testdata/sf0.001"


def same_as_sql(got, columns, table, rows, query):
    """Whether the Spark rows are those of DuckDB over a view of the same rows."""
    con = duckdb.connect()
    con.sql(f"create table {table} ({columns})")
    if rows:
        con.executemany(f"insert into {table} values ({', '.join('?' * len(rows[0]))})", rows)
    found = con.execute(query)
    names = [d[0] for d in found.description]
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r[n] for n in names) for r in got.select(*names).collect()), key=key) == sorted(found.fetchall(), key=key)


# -- numbers and apportionment -----------------------------------------------------------------------------------------

def test_numbered_cuts_equal_rows(spark):
    from pyspark.sql import functions as F
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), F.monotonically_increasing_id().alias("tie"))
    got = numbered(rows, [F.col("k").asc()], "n", "tie").collect()
    assert sorted(r.position for r in got) == list(range(3000))
    assert all(r.position // 1000 == r.k for r in got)


@pytest.mark.parametrize("seats", [0, 1, 2, 3, 7, 50, 1000])
def test_apportioned_as_highest_quotients(spark, seats):
    shares = {0: [1.0, 1.0, 1.0], 1: [1000.0, 3.0, 2.0, 2.0, 0.0, 0.5], 2: [0.0, 0.0], 3: [7.0]}
    rows = spark.createDataFrame([(g, i, s, seats) for g, x in shares.items() for i, s in enumerate(x)], "g long, id long, share double, seats long")
    got = {(r.g, r.id): r.won for r in apportioned(rows, "g", "share", "seats", "t").collect()}
    for g, x in shares.items():
        best = sorted((-s / (2 * k + 1), i) for i, s in enumerate(x) if s > 0 for k in range(seats))[:seats]
        assert [got[g, i] for i in range(len(x))] == [sum(j == i for _, j in best) for i in range(len(x))]


# -- mixing ------------------------------------------------------------------------------------------------------------

DOCS = "doc_id bigint, text varchar, source varchar, hash varchar, sid bigint, shard bigint"


def documents():
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    rows = [(i, words(7 * i % 40), "hot", "x", 1, 2) for i in range(120)] + [(500 + i, words(i), f"s{i % 7}", "x", 1, 2) for i in range(40)]
    rows += [(900, None, None, None, None, None), (901, "", "", None, None, None), (902, words(3), None, None, None, None), (None, words(9), "s1", None, None, None),
             (903, words(5000), "long", None, None, None), (500, words(4), "s1", None, None, None), (903, words(2), "hot", None, None, None), (904, " \t\n", "blank", None, None, None)]
    return rows + rows[:30]


@pytest.mark.parametrize("block, words, rows", [(16, 1 << 22, 1 << 10), (4, 300, 25), (1, 50, 8), (64, 100, 1000)])
def test_mixing_as_sql(spark, block, words, rows):
    docs = documents()
    table = spark.createDataFrame(docs, DOCS.replace("bigint", "long").replace("varchar", "string"))
    got = mix_sources(table, block=block, shard_words=words, shard_rows=rows)
    assert got.where("taken > 3 * size").count() == 0
    same_as_sql(got, DOCS, "documents", docs, sql.mixing(block, words, rows))


def test_mixing_spans_are_the_words_taken(spark):
    table = spark.createDataFrame(documents(), DOCS.replace("bigint", "long").replace("varchar", "string"))
    for r in mix_sources(table, block=4, shard_words=300, shard_rows=25).collect():
        ends = [0, *(s.start + s.length for s in r.spans)]
        assert all(e <= s.start for e, s in zip(ends, r.spans)) and ends[-1] <= r["size"]
        assert r.taken == r.passes * r["size"] + sum(s.length for s in r.spans)


def test_mixing_by_named_weights(spark):
    table = spark.createDataFrame(documents(), DOCS.replace("bigint", "long").replace("varchar", "string"))
    weights = spark.createDataFrame([("long", 1), ("hot", 1)], "source string, weight int")
    got = {r.source: r for r in mix_sources(table, weights).groupBy("source").agg({"target": "max", "taken": "sum", "source_size": "max"}).collect()}
    assert got["s1"]["sum(taken)"] == 0 and got["s1"]["max(target)"] == 0
    total = sum(r["max(source_size)"] for r in got.values())
    assert got["long"]["max(target)"] == got["hot"]["max(target)"] == total / 2
    assert all(abs(got[s]["sum(taken)"] - total / 2) <= 16 for s in ("long", "hot"))


def test_mixing_of_nothing(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    blank = spark.createDataFrame([(1, None, None), (None, "", "a")], "doc_id long, text string, source string")
    assert {(r["size"], r.target, r.taken) for r in mix_sources(blank).collect()} == {(0, 0.0, 0)}


# -- prefix trie -------------------------------------------------------------------------------------------------------

CHATS = "conv_id bigint, turn bigint, role varchar, text varchar, node bigint, depth bigint"


def conversations():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c % 3 if t > 2 else 0}", 1, 1) for c in range(230) for t in range(c % 9 + 1)]
    rows += [(c, t, "user", f"deep {t}", 1, 1) for c in (300, 301, 302, 400) for t in range(70 + c % 100)]
    rows += [(-5, 0, "user", "a", 1, 1), (-5, 1, None, None, 1, 1), (0, None, None, None, None, None), (207, 3, "user", "again", 1, 1), (207, 3, "user", "again", 1, 1),
             (None, 1, "user", "no id", 1, 1), (5000, 1, "user", "\n", 1, 1), (5001, 1, "", "", 1, 1), (5010, 0, "user", "long " * 20000, 1, 1)]
    return rows + [(9000 + i, t, "user", f"copy {t}", 1, 1) for i in range(60) for t in range(6)]


@pytest.mark.parametrize("height, part, ids", [(16, 256, 4096), (2, 4, 5), (3, 7, 1), (200, 3, 1000)])
def test_trie_as_sql(spark, monkeypatch, height, part, ids):
    monkeypatch.setattr(trie_module, "PART", part)
    monkeypatch.setattr(trie_module, "IDS", ids)
    rows = conversations()
    table = spark.createDataFrame(rows, CHATS.replace("bigint", "long").replace("varchar", "string"))
    same_as_sql(prefix_trie(table, height), CHATS, "conversations", rows, sql.PREFIX_TRIE)


def test_trie_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie(spark.createDataFrame([], schema)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).count() == 0
    # Conversation 1 has a checksum of 2207, remainder above its one turn or not: with no opening it may be turnless.
    alone = prefix_trie(spark.createDataFrame([(101, 0, "user", "x")], schema)).orderBy("depth").collect()
    assert alone[0].depth == 0 and alone[0].parent_conv_id is None and alone[-1].n_leaves == 1


# -- whitening ---------------------------------------------------------------------------------------------------------

def plain(vectors, components):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    covariance = centred.T @ centred / n
    values, onto = np.linalg.eigh(covariance)
    values, onto = values[::-1][:components], onto[:, ::-1][:, :components]
    deviation = [sum(int(v) ** 2 for v in row) for row in (n * x.astype(object) - sums.astype(object))]
    return n, deviation, centred @ onto / np.sqrt(values), values / np.trace(covariance)


def agree(got, want, places=1e-9):
    for k in range(want.shape[1]):
        sign = np.sign(got[np.abs(want[:, k]).argmax(), k] * want[np.abs(want[:, k]).argmax(), k])
        assert np.abs(sign * got[:, k] - want[:, k]).max() < places


def test_whitening_of_the_table(spark):
    import __spark_entry__ as entry
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, whitened, explained = plain([r.embedding for r in rows], 8)
    got = entry.queries()["op12_whitening"](spark, SF).orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component) for r in got] == [(r.vec_id, k) for r in rows for k in range(1, 9)]
    assert {r.n for r in got} == {n} and [r.deviation for r in got[::8]] == deviation
    agree(np.array([r.whitened for r in got]).reshape(-1, 8), whitened)
    assert np.allclose([r.explained for r in got[:8]], explained, rtol=1e-12)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_whitening_of_odd_rows(spark):
    draw = np.random.default_rng(3)
    good = [[float(v) for v in row] for row in draw.normal(size=(40, 5)) * [1, 10, 0.1, 3, 100] + [0, 5, 0, -7, 1e6]]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0], [1.0, None, 1.0, 1.0, 1.0], [nan, 1.0, 1.0, 1.0, 1.0], [1.0, inf, 1.0, 1.0, 1.0], [1.0, 1.0, 1.0, 1.0, -inf], [1e300, 0.0, 0.0, 0.0, 0.0]]
    rows = [(i, v, i, "w") for i, v in enumerate(good)] + [(100 + i, v, 0, "w") for i, v in enumerate(odd)] + [(None, good[0], 0, None), (3, good[3], 0, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, whitened string")
    got = sorted(whiten(table).collect(), key=lambda r: (r.vec_id is None, r.vec_id))
    kept = sorted((r for r in rows if r[1] is not None and r[1] in good), key=lambda r: (r[0] is None, r[0]))
    assert [r.vec_id for r in got] == [r[0] for r in kept]
    n, deviation, whitened, explained = plain([r[1] for r in kept], 5)
    assert {r.n for r in got} == {n} and [r.deviation for r in got] == deviation
    agree(np.array([r.whitened for r in got]), whitened, 1e-6)
    assert np.allclose(got[0].explained, explained, rtol=1e-6) and got[0].identity_error < 1e-6


def test_whitening_with_too_few_dimensions(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [float("nan")])], schema)).count() == 0
    one = whiten(spark.createDataFrame([(1, [0.5, 0.25])], schema)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, [None, None], [0.0, 0.0], 0.0)]
    far = whiten(spark.createDataFrame([(i, [1e9 * i, float(i)]) for i in range(4)], "vec_id long, embedding array<double>")).collect()
    assert all(r.deviation is None and r.whitened[0] is not None for r in far)
    flat = whiten(spark.createDataFrame([(i, [float(i), float(i), 1.0]) for i in range(9)], schema)).collect()
    assert all(r.whitened[1:] == [None, None] and abs(r.explained[0] - 1) < 1e-12 for r in flat) and flat[0].identity_error < 1e-12
    assert [r.whitened for r in whiten(spark.createDataFrame([(1, []), (2, [])], schema)).collect()] == [[], []]


@pytest.mark.parametrize("rank, dims", [(0, 3), (1, 1), (2, 5), (7, 7), (20, 33)])
def test_eigenpairs_of_semidefinite_matrices(rank, dims):
    half = np.random.default_rng(rank).normal(size=(dims, rank))
    matrix = half @ half.T
    factor = pivoted_cholesky(matrix)
    assert factor.shape == (dims, rank) and np.allclose(factor @ factor.T, matrix)
    pivots = [int(np.abs(c).argmax()) for c in factor.T]
    assert len(set(pivots)) == rank
    values, vectors = one_sided_jacobi(factor)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:rank]) and np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12)
