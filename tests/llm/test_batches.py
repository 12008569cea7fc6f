from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from airq.llm.common import BATCH_ROWS, keyed


def test_documents_go_to_python_in_bounded_batches(spark):
    conf = spark.conf
    was = conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        docs = keyed(spark.range(0, 3 * BATCH_ROWS, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text")))
        rows = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
        assert max(r.n for r in rows) <= BATCH_ROWS and sum(r.n for r in rows) == 3 * BATCH_ROWS
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
        keyed(docs)
        assert conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "100"
    finally:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
