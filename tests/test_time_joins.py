from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from airq.operators import asof


@pytest.fixture(scope="module")
def composites(spark):
    days = [dt.date(2025, 1, 1), dt.date(2025, 1, 17), dt.date(2025, 3, 22)]
    return spark.createDataFrame([(d,) for d in days], "c date")


def targets(spark, *days):
    return spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "d date")


def pairs(df, name):
    return {str(r.d): (str(r[name]) if r[name] else None, r.offset_days) for r in df.collect()}


def test_asof_no_future(spark, composites):
    t = targets(spark, "2024-12-31", "2025-01-01", "2025-01-16", "2025-02-18", "2025-02-19")
    got = pairs(asof.asof_composite(t, composites, "d", "c"), "composite_date")
    assert got == {"2024-12-31": (None, None), "2025-01-01": ("2025-01-01", 0), "2025-01-16": ("2025-01-01", 15),
                   "2025-02-18": ("2025-01-17", 32), "2025-02-19": (None, None)}


def test_asof_either_side_prefers_the_earlier(spark, composites):
    t = targets(spark, "2025-01-09", "2025-02-18", "2025-02-19", "2025-01-10")
    got = pairs(asof.asof_composite(t, composites, "d", "c", no_future=False), "composite_date")
    assert got == {"2025-01-09": ("2025-01-01", 8), "2025-02-18": ("2025-01-17", 32),
                   "2025-02-19": ("2025-03-22", -31), "2025-01-10": ("2025-01-17", -7)}


def test_interval(spark, composites):
    t = targets(spark, "2025-01-16", "2025-01-17", "2025-02-02")
    got = pairs(asof.interval_composite(t, composites, "d", "c"), "composite_date")
    assert got == {"2025-01-16": ("2025-01-01", 15), "2025-01-17": ("2025-01-17", 0), "2025-02-02": (None, None)}


def test_tolerance_is_signed(spark, composites):
    t = targets(spark, "2025-01-14", "2025-01-20", "2025-01-21")
    out = asof.tolerance_match(t, composites, "d", "c")
    assert pairs(out, "observed_date") == {"2025-01-14": ("2025-01-17", -3), "2025-01-20": ("2025-01-17", 3), "2025-01-21": (None, None)}
    assert {str(r.d): r.no_future for r in out.collect()}["2025-01-14"] is False


def test_composite_start(one):
    starts = [asof.composite_start(F.lit(d).cast("date")).cast("string") for d in ("2000-02-18", "2000-03-04", "2000-03-05")]
    assert one(*starts) == ("2000-02-18", "2000-02-18", "2000-03-05")


def test_keyed_asof(spark):
    comp = spark.createDataFrame([("a", dt.date(2025, 1, 1)), ("b", dt.date(2025, 1, 5))], "k string, c date")
    t = spark.createDataFrame([("a", dt.date(2025, 1, 6)), ("b", dt.date(2025, 1, 6)), ("z", dt.date(2025, 1, 6))], "k string, d date")
    got = {r.k: r.offset_days for r in asof.asof_composite(t, comp, "d", "c", by=["k"]).collect()}
    assert got == {"a": 5, "b": 1, "z": None}


@pytest.mark.parametrize("back, ahead", [(32, 0), (4, 4)])
def test_merge_as_of_carries_over_partitions(spark, back, ahead):
    """Against brute force: keys that span many range partitions, gaps, NULL keys and dates, repeated rows."""
    import random
    draw = random.Random(4)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    composites = [(draw.choice(["a", "b", "c", None]), draw.choice([day(draw.randrange(900)), None])) for _ in range(60)] + [("a", day(3))] * 3
    targets = [(i, "a" if i % 2 else draw.choice(["b", "c", "d", None]), draw.choice([day(draw.randrange(900)), day(5), None])) for i in range(400)]
    left = spark.createDataFrame(targets, "i int, k string, date date").repartition(7)
    right = spark.createDataFrame(composites, "k string, composite date")
    out = asof._merged(left, "date", right, "composite", ["k"], back, ahead, "m", "o", "left").collect()
    assert len(out) == len(targets)
    got = {r.i: (r.m, r.o) for r in out}
    for i, k, d in targets:
        near = sorted((abs((d - c).days), c) for kk, c in composites if c and d and kk == k and kk is not None and -ahead <= (d - c).days <= back)
        assert got[i] == ((near[0][1], (d - near[0][1]).days) if near else (None, None)), (i, k, d)


def test_blocks_hand_on_what_they_end_with(spark, monkeypatch):
    comp = spark.createDataFrame([(i % 3, dt.date(2025, 1, 1) + dt.timedelta(days=11 * (i // 3))) for i in range(12)], "k int, c date")
    t = spark.createDataFrame([(i % 4, dt.date(2024, 12, 25) + dt.timedelta(days=i // 4)) for i in range(240)], "k int, d date")

    def rows():
        return sorted(map(str, asof.tolerance_match(t, comp, "d", "c", 5, by=["k"]).collect()))

    want = rows()
    for bits in (0, 2):
        monkeypatch.setattr(asof, "BLOCK", bits)
        assert rows() == want
