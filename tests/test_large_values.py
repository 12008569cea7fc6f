"""Values that lie exactly on a border or a breakpoint."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from airq.functions import geo
from airq.operators.daily import daily_mean

TRIANGLE = [(77.0, 28.4), (77.4, 28.4), (77.4, 28.8)]


def test_points_on_a_slanted_border_are_outside(spark):
    at = spark.range(1, 400).select(
        (F.lit(77.0) + F.col("id") / 1000.0).alias("x"), (F.lit(28.4) + F.col("id") / 1000.0).alias("y"))
    inside = geo.point_in_polygon(F.col("x"), F.col("y"), TRIANGLE)
    assert at.where(inside).count() == 0
    below = geo.point_in_polygon(F.col("x"), F.col("y") - 1e-9, TRIANGLE)
    assert at.where(below).count() == 399


def test_daily_mean_does_not_depend_on_the_order_of_addition(spark):
    def day(values):
        rows = [(i, "S1", "x", "c", 1.0, 2.0, dt.datetime(2024, 1, 1, i), v) for i, v in enumerate(values)]
        return daily_mean(spark.createDataFrame(
            rows, "ordinal long, station_id string, source string, country string, latitude double, longitude double, "
                  "timestamp timestamp, pm25_ug_m3 double").coalesce(1)).first()["pm25_daily"]

    values = [0.1, 0.2, 0.3, 54.8, 221.6]
    assert day(values) == day(values[::-1]) == day([0.3, 221.6, 0.1, 54.8, 0.2]) == 55.4
    assert day([1e300, -1e300, 3.0]) == 1.0
    assert day([0.1] * 10) == 0.1
