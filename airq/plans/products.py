"""Queries on stored products: layers read by window, gated publishing, station files of mixed dialects."""

from __future__ import annotations

from pyspark.sql import functions as F

from airq.plans.registry import day, query, stamp
from airq.schemas import TARGET
from airq.session import new_shared_path
from airq.sources import domain, layer_store as LS, publish as P
from airq.sources.dialects import read_mixed_station_csv

# --------------------------------------------------------------------- layers

_STORED_SQL = """
WITH stored AS (SELECT 'value' AS layer, obs_date, row, col, value FROM pixels UNION ALL SELECT 'discount', obs_date, row, col, discount FROM pixels)
"""


def _stored_layers(spark, sf_dir) -> str:
    px = domain.pixels(spark, sf_dir)
    layers = px.select(F.lit("value").alias("layer"), "obs_date", "row", "col", F.col("value").cast("double").alias("value")).unionByName(
        px.select(F.lit("discount").alias("layer"), "obs_date", "row", "col", F.col("discount").cast("double").alias("value")))
    path = new_shared_path(spark, "layers")
    LS.write_layers(layers, path, tile_rows=64)
    return path


@query("pruned_layer_window", parts=["pixels"], sql=f"""
{_STORED_SQL.strip()}
SELECT layer, strftime(obs_date, '%Y-%m-%d') AS date, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, CAST(value AS DOUBLE) AS value FROM stored
WHERE layer = 'value' AND obs_date BETWEEN DATE '1994-03-05' AND DATE '1995-02-10' AND row BETWEEN 3 AND 70
""")
def pruned_layer_window(spark, sf_dir):
    """The table's pixels in the store, and one window of one layer read back."""
    out = LS.read_window(spark, _stored_layers(spark, sf_dir), ["value"], "1994-03-05", "1995-02-10", (3, 70), 64)
    return out.select("layer", day("obs_date"), "row", "col", "value")


@query("layer_windows", parts=["pixels"], sql=f"""
{_STORED_SQL.strip()},
w AS (SELECT s_suppkey AS window_id, CASE WHEN s_suppkey % 2 = 0 THEN 'value' ELSE 'discount' END AS layer,
  DATE '1993-01-01' + CAST(s_suppkey % 700 AS INT) AS a, DATE '1993-01-01' + CAST(s_suppkey % 700 + 40 AS INT) AS b, s_suppkey % 50 AS r0, s_suppkey % 50 + 20 AS r1 FROM supplier)
SELECT window_id, layer, count(*) AS pixels, ROUND(sum(value), 4) AS total FROM stored JOIN w USING (layer)
WHERE obs_date BETWEEN a AND b AND row BETWEEN r0 AND r1 GROUP BY 1, 2
""")
def layer_windows(spark, sf_dir):
    """Windows that are rows of a table; the store's folders are pruned by what they name."""
    k = F.col("s_suppkey")
    start = F.date_add(F.lit("1993-01-01").cast("date"), (k % 700).cast("int"))
    windows = domain.table(spark, sf_dir, "supplier").select(
        k.alias("window_id"), F.when(k % 2 == 0, "value").otherwise("discount").alias("layer"), start.alias("first"), F.date_add(start, 40).alias("last"),
        (k % 50).alias("row_from"), (k % 50 + 20).alias("row_to"))
    store = spark.read.parquet(_stored_layers(spark, sf_dir))
    return LS.read_windows(store, windows, 64).groupBy("window_id", "layer").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.sum("value"), 4).alias("total"))


# ----------------------------------------------------------------- publishing

_GATED = ["AOD", "temperature_c", "NDVI", "road_density"]
_COUNTED = ["missing_target", "non_finite_features", "missing_date", "duplicate_keys"]
_BAD_SQL = " OR ".join(f'"{f}" IS NULL' for f in _GATED)


@query("published_products", parts=["training"], sql=f"""
WITH t AS (
  SELECT 'training_complete' AS product, * FROM training WHERE complete_case
  UNION ALL SELECT 'training_raw', * FROM training UNION ALL SELECT 'training_raw', * FROM training WHERE dayofmonth(date) = 7),
g AS (
  SELECT product, count(*) AS n_rows, count(*) FILTER ("PM2.5" IS NULL) AS missing_target, count(*) FILTER ({_BAD_SQL}) AS non_finite_features,
    count(*) FILTER (date IS NULL) AS missing_date, count(*) - count(DISTINCT (station_id, date)) AS duplicate_keys FROM t GROUP BY product)
SELECT *, CASE WHEN missing_target + non_finite_features + missing_date + duplicate_keys > 0 THEN 'REFUSED' ELSE 'ACCEPTED' END AS status,
  CASE WHEN missing_target + non_finite_features + missing_date + duplicate_keys > 0 THEN 0 ELSE n_rows END AS visible_rows FROM g
""")
def published_products(spark, sf_dir):
    """One product that passes its gates and one that does not; what readers can see of both."""
    training = domain.written_training(spark, sf_dir)
    folder = new_shared_path(spark, "products")
    offered = {"training_complete": training.where("complete_case"), "training_raw": training.unionByName(training.where(F.dayofmonth("date") == 7))}
    visible = F.lit(0).cast("long")
    for product, df in offered.items():
        gates = P.model_input_gates(_GATED, TARGET)
        if P.publish(df, product, folder, gates, {"duplicate_keys": P.unique_key_check(["station_id", "date"])}, [*_GATED, TARGET, "date"]):
            visible = F.when(F.col("product") == product, P.read_product(spark, folder, product).count()).otherwise(visible)
    counts = [F.coalesce(F.try_element_at("failed", F.lit(c)), F.lit(0)).cast("long").alias(c) for c in _COUNTED]
    return P.manifest(spark, folder).select("product", "status", "n_rows", *counts, visible.alias("visible_rows"))


# ---------------------------------------------------------------------- files


@query("mixed_station_files", parts=["obs"], sql="""
SELECT CAST(ordinal AS BIGINT) AS ordinal, station_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, latitude, longitude, pm AS "PM2.5",
  CASE WHEN ordinal % 3 = 2 THEN 'Zürich' END AS note FROM obs
""")
def mixed_station_files(spark, sf_dir):
    """All observations in files of three dialects, read back as one table."""
    obs = domain.observations(spark, sf_dir).withColumns({"timestamp": F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), "note": F.lit("Zürich")})
    path = new_shared_path(spark, "station-files")
    kinds = [(",", "UTF-8", ["station_id", "timestamp", "latitude", "longitude", "PM2.5"]), (";", "UTF-8", ["site_id", "from_date", "lat", "lng", "pm2_5"]),
             ("\t", "ISO-8859-1", ["id", "time", "lat", "lon", "pm25", "note"])]
    for i, (sep, encoding, names) in enumerate(kinds):
        part = obs.where(F.col("ordinal") % 3 == i)
        columns = ["station_id", "timestamp", "latitude", "longitude", "PM2.5", "note"][:len(names)]
        (part.select("ordinal", *[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)])
         .write.option("header", True).option("sep", sep).option("encoding", encoding).csv(f"{path}/kind={i}"))
    read = read_mixed_station_csv(spark, [f"{path}/kind={i}" for i in range(len(kinds))], timezone="UTC")
    return read.select(F.col("ordinal").cast("long").alias("ordinal"), "station_id", stamp("timestamp", "timestamp"), "latitude", "longitude", "`PM2.5`", "note")
