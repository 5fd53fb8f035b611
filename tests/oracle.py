"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd

TESTDATA = os.environ.get("TAPELOOM_TESTDATA", "/root/testdata")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "item"):
        return _cell(v.item())
    if isinstance(v, int):
        return f"{float(v):.9g}"
    return str(v)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    out.sort(key=lambda t: tuple((x is None, x or "") for x in t))
    return [columns[i] for i in order], out


def compare(spark, con, key, q, sf_dir):
    t = time.time()
    df = q.run(spark, sf_dir)
    got_cols, got = canon(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if q.sql is None:
        return None, f"{key}: {len(got)} rows, no SQL, {took:.1f}s", len(got)
    t = time.time()
    res = con.execute(q.sql)
    want_cols, want = canon([d[0] for d in res.description], res.fetchall())
    dtook = time.time() - t
    tail = f"{len(got)} rows, {took:.1f}s (duckdb {dtook:.1f}s)"
    if got_cols != want_cols:
        return False, f"{key}: columns {got_cols} != {want_cols}", len(got)
    if got == want:
        return True, f"{key}: ok {tail}", len(got)
    gs, ws = set(got), set(want)
    only_got = [r for r in got if r not in ws][:3]
    only_want = [r for r in want if r not in gs][:3]
    return (
        False,
        f"{key}: MISMATCH {tail} vs {len(want)} rows\n  cols {got_cols}\n  spark only {only_got}\n  sql only   {only_want}",
        len(got),
    )


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tapeloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf = f"{TESTDATA}/sf{sys.argv[1]}"
    entry.queries()
    from tapeloom.catalog.base import REGISTRY

    wanted = sys.argv[2:]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for key, q in REGISTRY.items():
        if wanted and not any(key == w or (w.endswith("*") and key.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, msg, n = compare(spark, con, key, q, sf)
        except Exception as e:  # noqa: BLE001
            ok, msg, n = False, f"{key}: ERROR {str(e)[:1500]}", 0
        bad += ok is False
        print(msg + ("   <-- EMPTY" if n == 0 else ""), flush=True)
    print("failures:", bad)
