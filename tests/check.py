"""Run registered queries beside their check SQL: python tests/check.py [sf] [name-prefix ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(root: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(repr(v)) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    made = [tuple(plain(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(made, key=repr)


def compare(spark_df, con, sql):
    """'' when equal, else the first difference. Types must agree too (int, float, bool, text)."""
    a_cols, a = rows_of(spark_df.columns, spark_df.collect())
    cur = con.execute(sql)
    b_cols, b = rows_of([d[0] for d in cur.description], cur.fetchall())
    if a_cols != b_cols:
        return f"columns {a_cols} vs {b_cols}", len(a)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}", len(a)
    for x, y in zip(a, b):
        if x != y or [type(v) for v in x] != [type(v) for v in y]:
            return f"{x} vs {y}", len(a)
    return "", len(a)


def main():
    from phrasebench.queries import ORACLES, QUERIES
    from phrasebench.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    prefixes = sys.argv[2:]
    root = f"/root/testdata/{sf}"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, root)
            diff, n = compare(df, con, ORACLES[name]) if name in ORACLES else ("", df.count())
            kind = "sql" if name in ORACLES else "rows"
        except Exception as e:  # report and go on
            diff, n, kind = f"{type(e).__name__}: {str(e)[:900]}", -1, "error"
        bad += bool(diff)
        print(f"{'BAD ' if diff else 'ok  '} {name} {kind} rows={n} {time.time() - start:.1f}s {diff[:1200]}", flush=True)
    print("bad", bad)
    spark.stop()


if __name__ == "__main__":
    main()
