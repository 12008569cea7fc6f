"""Session construction and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

# Engine settings every operator assumes. Shuffle parallelism and memory are
# deployment choices and are deliberately not fixed here.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even when that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
}
# Only possible when the session is created: no call-site capture per expression.
STARTUP_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app_name: str = "airq", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings the operators rely on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **STARTUP_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_engine_conf(spark: SparkSession) -> None:
    """Pin the runtime settings on a session somebody else created."""
    for key, value in ENGINE_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    A cluster must name it in ``spark.checkpoint.dir``. Only with a local master
    a temporary folder is chosen where that is unset, once per session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    made = spark.conf.get("airq.shared.dir", None)
    if not made:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        made = tempfile.mkdtemp(prefix="airq-")
        spark.conf.set("airq.shared.dir", made)
    return made


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one intermediate table."""
    return f"{shared_dir(spark).rstrip('/')}/airq-{name}-{uuid.uuid4().hex}"


# Paths of the tables this process wrote to the shared folder and may delete again.
_WRITTEN: set[str] = set()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several passes will read to the shared folder.

    The copy cuts the lineage, is columnar, and survives lost executors. Unlike
    ``checkpoint()`` it computes its input once. Its size is known to the
    optimizer, which therefore broadcasts it in a join exactly when it is small.
    """
    path = new_shared_path(df.sparkSession, name)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    # The frame itself names its table; a frame derived from it does not.
    written._airq_path = path
    _WRITTEN.add(path)
    return written


def materialize_counting(df: DataFrame, name: str, condition: Column) -> tuple[DataFrame, int]:
    """Materialize and, in the same job, count the rows that meet a condition."""
    seen = Observation()
    watched = df.observe(seen, F.count(F.when(condition, 1)).alias("n"))
    return materialize(watched, name), int(seen.get["n"])


def spread(df: DataFrame) -> DataFrame:
    """Rows in a task per core at least: a stored table of few small files is otherwise read by few tasks, however much work a row is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize`; other frames are left alone."""
    path = df.__dict__.get("_airq_path")
    if path in _WRITTEN:
        _WRITTEN.discard(path)
        _delete(df.sparkSession, path)


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Delete, on leaving, the tables that were materialized inside; store the results before."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in _WRITTEN - before:
            _WRITTEN.discard(path)
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
