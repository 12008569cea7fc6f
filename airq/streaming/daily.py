"""Row-wise quality control and daily means on a stream of observations.

Global rules (outliers by median, zones) need all rows and stay batch jobs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from airq.functions.units import to_ug_m3
from airq.operators.qc import MAX_PM25
from airq.session import new_shared_path

LATENESS = "2 days"
#: Event time of the row that says that a source has ended; no observation is as late.
END = dt.datetime(9000, 1, 1)


def end_input(spark: SparkSession, folder: str, obs: DataFrame) -> None:
    """Close the source ``folder`` of a stream: a row from beyond all time moves the watermark past every day.

    ``obs`` gives the columns. Write it when no more files will come.
    """
    types = dict(obs.dtypes)
    end = [F.lit(END).cast(t).alias(c) if c == "timestamp" else F.lit(None).cast(t).alias(c) for c, t in types.items()]
    spark.range(1).select(*end).coalesce(1).write.mode("append").parquet(folder)


def clean_stream(obs: DataFrame, lateness: str = LATENESS, max_pm25: float = MAX_PM25, ordinal: str | None = None) -> DataFrame:
    """One row per (station, timestamp) inside the watermark, if it is valid.

    As in batch the first copy is judged and stands for the others. With ``ordinal``
    that is the copy with the smallest one, held in state until the watermark has
    passed its time; without, the copy that arrives first.
    """
    value = to_ug_m3(F.col("`PM2.5`"), F.col("units"))
    timed = obs.where(F.col("timestamp").isNotNull()).withWatermark("timestamp", lateness)
    # A test of the event time stays above the watermark, so the closing row is seen there and nowhere else.
    timed = timed.where(F.col("timestamp") < F.lit(END))
    if ordinal is None:
        first = timed.dropDuplicatesWithinWatermark(["station_id", "timestamp"])
    else:
        rest = [c for c in obs.columns if c not in ("station_id", "timestamp")]
        first = timed.groupBy("station_id", "timestamp").agg(
            F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(ordinal)).alias("_row")).select(
            "station_id", "timestamp", *[F.col(f"_row.`{c}`").alias(c) for c in rest])
    return (first.withColumn("pm25_ug_m3", value)
            .where(F.col("latitude").between(-90.0, 90.0) & F.col("longitude").between(-180.0, 180.0)
                   & F.col("pm25_ug_m3").between(0.0, max_pm25)))


def daily_stream(clean: DataFrame, min_observations: int = 1) -> DataFrame:
    """Mean and count per station and UTC day; a day is emitted once it is closed.

    The days that the watermark has not passed when the input ends are emitted only
    where the source was closed by :func:`end_input`."""
    days = clean.groupBy(F.window("timestamp", "1 day").alias("w"), "station_id").agg(
        F.avg("pm25_ug_m3").alias("pm25_daily"), F.count("pm25_ug_m3").alias("observation_count"))
    return days.where(F.col("observation_count") >= min_observations).select(
        "station_id", F.to_date("w.start").alias("date"), "pm25_daily", "observation_count")


def start_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream to Parquet until the input that exists now is used up."""
    return (stream.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def run_to_table(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over its present input and read the result table back."""
    path = new_shared_path(spark, name)
    started = start_table(stream, f"{path}/data", f"{path}/checkpoint")
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")
