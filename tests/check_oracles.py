"""Run queries in Spark and their SQL in DuckDB and compare whole results.

    python tests/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(v):
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return ("f", "nan" if math.isnan(v) else f"{round(v, 6) + 0.0:.6f}")
    if isinstance(v, int):
        return ("i", v)
    if v is None:
        return ("n", "")
    if isinstance(v, (list, tuple)):
        return ("l", tuple(normal(x) for x in v))
    return (type(v).__name__, str(v))


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in data), key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name):
    """(state, number of rows, spark seconds, duckdb seconds, note)"""
    start = time.perf_counter()
    df = contract.queries()[name](spark, sf_dir)
    got = df.collect()
    took = time.perf_counter() - start
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return "rows-only", len(got), took, 0.0, ""
    start = time.perf_counter()
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rel.fetchall()
    duck_took = time.perf_counter() - start
    if sorted(names) != sorted(df.columns):
        return "COLUMNS", len(got), took, duck_took, f"{sorted(df.columns)} vs {sorted(names)}"
    a, b = rows(df.columns, [tuple(r) for r in got]), rows(names, want)
    if a == b:
        return "ok", len(got), took, duck_took, ""
    diff = [x for x in zip(a, b) if x[0] != x[1]][:2]
    return "DIFF", len(got), took, duck_took, f"{len(a)} vs {len(b)} rows; {diff}"


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    chosen = args[1:] or list(contract.queries())
    spark, con = session(), duck(sf)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in chosen:
        try:
            state, n, took, duck_took, note = compare(spark, con, sf, name)
        except Exception as e:  # report and go on
            state, n, took, duck_took, note = "ERROR", 0, 0.0, 0.0, str(e)[:1500]
        bad += state not in ("ok", "rows-only")
        print(f"{state:10s} {name:32s} rows={n:<7d} spark={took:6.2f}s duckdb={duck_took:5.2f}s {note}", flush=True)
    print("bad:", bad)
