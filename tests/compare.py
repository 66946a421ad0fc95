"""Run every registered query in Spark and DuckDB and compare rows, columns and values."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name, fn, sql):
    """None when equal, else a short description; rows-only queries return their row count."""
    df = fn(spark, sf_dir)
    names, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(left)
    cur = con.execute(sql)
    other, right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != other:
        return f"columns {names} vs {other}", len(left)
    if left != right:
        only_left = [r for r in left if r not in set(right)][:2] if len(left) < 20000 else []
        only_right = [r for r in right if r not in set(left)][:2] if len(left) < 20000 else []
        return f"{len(left)} vs {len(right)} rows; spark only {str(only_left)[:1500]}; sql only {str(only_right)[:1500]}", len(left)
    return None, len(left)


if __name__ == "__main__":
    from corpus_audit.plans.catalog import ORACLES, QUERIES
    from corpus_audit.session import build_session

    sf_dir = sys.argv[1]
    chosen = sys.argv[2:] or list(QUERIES)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in chosen:
        t = time.time()
        try:
            problem, n = compare(spark, con, sf_dir, name, QUERIES[name], ORACLES.get(name))
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:900]}", -1
        bad += problem is not None
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'OK  ' if problem is None else 'FAIL'} {name} [{kind}] rows={n} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print(f"{len(chosen)} queries, {bad} differ")
