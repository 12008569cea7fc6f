from __future__ import annotations

from pyspark.sql import functions as F

from airq.schemas import OBSERVATION_SCHEMA
from airq.streaming.daily import clean_stream, daily_stream, end_input, run_to_table


def test_closed_stream_emits_every_day_of_the_first_copies(spark, tmp_path):
    """Late rows within the lateness, copies that arrive before the first by ordinal, and the last days."""
    rows = [(2, "A", "2025-01-01 01:00:00", 99.0), (1, "A", "2025-01-01 01:00:00", 10.0), (3, "A", "2025-01-03 01:00:00", 30.0), (4, "B", "2025-01-02 23:00:00", 5.0),
            (5, "B", "2025-01-03 00:00:00", 7.0), (6, "B", "2025-01-03 00:00:00", -1.0), (8, "C", "2025-01-03 00:00:00", 1.0), (7, "C", "2025-01-03 00:00:00", -1.0), (9, "C", None, 1.0)]
    df = spark.createDataFrame(rows, "ordinal long, station_id string, ts string, v double").select(
        "ordinal", "station_id", F.col("ts").cast("timestamp").alias("timestamp"), F.lit(28.0).alias("latitude"), F.lit(77.0).alias("longitude"),
        F.col("v").alias("PM2.5"), F.lit("ug/m3").alias("units"))
    folder = str(tmp_path / "in")
    df.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    end_input(spark, folder, df)
    got = run_to_table(spark, daily_stream(clean_stream(stream, ordinal="ordinal")), "t").collect()
    assert sorted((r.station_id, str(r.date), r.pm25_daily, r.observation_count) for r in got) == [
        ("A", "2025-01-01", 10.0, 1), ("A", "2025-01-03", 30.0, 1), ("B", "2025-01-02", 5.0, 1), ("B", "2025-01-03", 7.0, 1)]


def test_stream_drops_bad_and_duplicate_rows(spark, tmp_path):
    rows = [("A", "2025-01-01 01:00:00", 10.0, "ug/m3", 28.0), ("A", "2025-01-01 01:00:00", 99.0, "ug/m3", 28.0),
            ("A", "2025-01-01 02:00:00", 0.02, "mg/m3", 28.0), ("A", "2025-01-01 03:00:00", -4.0, "ug/m3", 28.0),
            ("A", "2025-01-01 04:00:00", 5.0, "ppm", 28.0), ("A", "2025-01-01 05:00:00", 5.0, "ug/m3", 95.0),
            ("A", "2025-01-01 06:00:00", -1.0, "ug/m3", 28.0), ("A", "2025-01-01 06:00:00", 7.0, "ug/m3", 28.0),
            ("A", "2025-01-09 00:00:00", 1.0, "ug/m3", 28.0)]
    df = spark.createDataFrame(rows, "station_id string, ts string, v double, units string, latitude double")
    df = df.select("station_id", F.lit("s").alias("source"), F.lit("IN").alias("country"), "latitude", F.lit(77.0).alias("longitude"),
                   F.col("ts").cast("timestamp").alias("timestamp"), F.col("v").alias("PM2.5"), "units", F.lit("ok").alias("quality_flag"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(OBSERVATION_SCHEMA).parquet(str(tmp_path / "in"))
    got = [(r.station_id, str(r.date), r.observation_count) for r in run_to_table(spark, daily_stream(clean_stream(stream)), "t").collect()]
    assert got == [("A", "2025-01-01", 2)]
