"""Products become visible only after their checks: written aside, judged, then renamed or discarded.

Row checks are counted while the rows are written, so a product is computed once.
Checks on the whole table read the written copy. A reader of the product's path
sees the whole old version or the whole new one, never a refused one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from airq.operators.reports import duplicate_keys
from airq.schemas import TARGET
from airq.session import new_shared_path

#: Counts violations of a table that is written: a frame of one row and one number.
TableCheck = Callable[[DataFrame], DataFrame]
MANIFEST = "product string, version string, status string, n_rows long, failed map<string,long>, path string, published_at timestamp"


def finite(column: str) -> Column:
    c = F.col(f"`{column}`").cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def model_input_gates(features: list[str], target: str = TARGET) -> dict[str, Column]:
    """Row checks of a table that a model learns from: conditions that a bad row meets."""
    some = F.lit(False)
    for f in features:
        some = some | ~finite(f)
    return {"missing_target": ~finite(target), "non_finite_features": some, "missing_date": F.col("date").isNull()}


def unique_key_check(keys: list[str]) -> TableCheck:
    return lambda df: duplicate_keys(df, keys)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(df: DataFrame, product: str, folder: str, gates: dict[str, Column] | None = None,
            checks: dict[str, TableCheck] | None = None, columns: list[str] | None = None, allow_empty: bool = False) -> bool:
    """Write ``df`` as the next version of a product below ``folder`` if nothing is wrong with it; says whether it was.

    ``gates`` are conditions that no row may meet, ``checks`` count violations of the
    whole table, ``columns`` must exist. A product without rows is refused unless
    allowed. Either way the manifest gets a row with all counts that are not 0. A
    refused version is deleted; versions published before stay.
    """
    spark = df.sparkSession
    version = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    absent = [c for c in columns or [] if c not in df.columns]
    if absent:
        _record(spark, folder, product, version, False, 0, {f"missing column {c}": 1 for c in absent}, "")
        return False
    seen, staged = Observation(), new_shared_path(spark, "staged")
    gates = gates or {}
    counts = [F.count(F.when(bad, 1)).alias(f"g{i}") for i, bad in enumerate(gates.values())]
    df.observe(seen, F.count(F.lit(1)).alias("n"), *counts).write.parquet(staged)
    found = {name: seen.get[f"g{i}"] for i, name in enumerate(gates)}
    written = spark.read.schema(df.schema).parquet(staged)
    for name, check in (checks or {}).items():
        found[name] = check(written).first()[0] or 0
    failed = {name: int(n) for name, n in found.items() if n}
    n = int(seen.get["n"])
    if not n and not allow_empty:
        failed["no rows"] = 1
    source, system = _files(spark, staged)
    path = f"{folder.rstrip('/')}/{product}/{version}"
    if failed:
        system.delete(source, True)
    else:
        target, _ = _files(spark, path)
        system.mkdirs(target.getParent())
        if not system.rename(source, target):
            raise RuntimeError(f"{staged} could not be renamed to {path}")
    _record(spark, folder, product, version, not failed, n, failed, "" if failed else path)
    return not failed


def _record(spark: SparkSession, folder: str, product: str, version: str, accepted: bool, n: int, failed: dict[str, int], path: str) -> None:
    """One row of the manifest; it is written last, so what it names exists."""
    row = (product, version, "ACCEPTED" if accepted else "REFUSED", n, failed, path, dt.datetime.now(dt.timezone.utc))
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/_manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """All versions that were ever offered."""
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/_manifest")


def read_product(spark: SparkSession, folder: str, product: str) -> DataFrame:
    """The latest published version."""
    last = manifest(spark, folder).where((F.col("product") == product) & (F.col("status") == "ACCEPTED")).orderBy(F.col("version").desc()).first()
    if last is None:
        raise ValueError(f"no version of {product!r} is published")
    return spark.read.parquet(last["path"])
