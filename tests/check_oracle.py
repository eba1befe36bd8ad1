"""Compare registered queries with their SQL twins: python tests/check_oracle.py [sf] [names...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

from __spark_entry__ import oracle_sql, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame):
    cols = sorted(frame.columns)
    rows = []
    for row in frame[cols].itertuples(index=False, name=None):
        rows.append(tuple(None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else v for v in row))
    return cols, sorted(rows, key=lambda r: tuple((v is None, str(type(v)) if v is None else "", str(v)) for v in r))


def compare(spark_frame, duck_frame) -> str:
    a_cols, a = canonical(spark_frame)
    b_cols, b = canonical(duck_frame)
    if a_cols != b_cols:
        return f"columns differ: {set(a_cols) ^ set(b_cols)}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = {}
    for x, y in zip(a, b):
        for col, u, v in zip(a_cols, x, y):
            if u != v:
                bad.setdefault(col, []).append((u, v))
    if bad:
        return "; ".join(f"{c}: {len(v)} differ e.g. {v[0]}" for c, v in bad.items())
    kinds = [
        (c, str(spark_frame[c].dtype), str(duck_frame[c].dtype))
        for c in a_cols
        if str(spark_frame[c].dtype) != str(duck_frame[c].dtype)
    ]
    return "ok" + (f" (types {kinds})" if kinds else "")


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(queries())
    con, spark = connect(sf_dir), session()
    for name in names:
        start = time.time()
        try:
            got = queries()[name](spark, sf_dir).toPandas()
            took = time.time() - start
            sql = oracle_sql().get(name)
            verdict = compare(got, con.execute(sql).df()) if sql else f"rows only: {len(got)}"
        except Exception as exc:  # report and go on with the next query
            took, verdict = time.time() - start, f"ERROR {type(exc).__name__}: {str(exc)[:900]}"
        print(f"{name:32s} {took:6.2f}s {len(got) if 'got' in dir() else -1:7d} {verdict}", flush=True)
