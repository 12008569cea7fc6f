"""Every registered query runs at the smallest scale; SQL must agree where given."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF)
    if name in SQL:
        assert compare(frame, con, SQL[name]) is None
    else:
        assert frame.count() > 0
