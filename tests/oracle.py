"""Compare registered queries with their SQL, as strictly as values allow.

Usage: python tests/oracle.py SF_DIR [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float) and value == 0.0:
        return 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _key(row):
    return tuple((v is None, str(type(v).__name__), str(v)) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(table, key=_key)


def compare(spark_df, con, sql) -> str | None:
    """None when equal, else what differs."""
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds_got = [{type(r[i]).__name__ for r in got if r[i] is not None} for i in range(len(got_cols))]
    kinds_want = [{type(r[i]).__name__ for r in want if r[i] is not None} for i in range(len(got_cols))]
    if kinds_got != kinds_want:
        bad = [(c, a, b) for c, a, b in zip(got_cols, kinds_got, kinds_want) if a != b]
        return f"types differ: {bad}"
    diff = [(a, b) for a, b in zip(got, want) if a != b]
    if diff:
        return f"{len(diff)} rows differ of {len(got)}, e.g. {got_cols}\n    {diff[0][0]}\n    {diff[0][1]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from airq.session import build_session
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", conf={
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        begin = time.time()
        try:
            frame = queries[name](spark, sf_dir)
            if name in sqls:
                result = compare(frame, con, sqls[name])
                note = "ok" if result is None else f"DIFF {result}"
            else:
                note = f"rows only: {frame.count()}"
        except Exception as exc:
            note = f"ERROR {type(exc).__name__}: {str(exc)[:900]}"
        bad += note.startswith(("DIFF", "ERROR"))
        print(f"{name:34s} {time.time() - begin:6.2f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
