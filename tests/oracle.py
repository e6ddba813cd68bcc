"""Run registered queries on Spark and their SQL on DuckDB, and compare whole results.

Usage: python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
import traceback
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lectern")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def plain(value):
    """One spelling for values that both engines may hold in different types."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) and abs(value) < 1e15 else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, (float, decimal.Decimal)):
        return "float"
    return type(value).__name__


def kinds(columns, rows):
    found = {c: set() for c in columns}
    for row in rows:
        for c, v in zip(columns, row):
            if v is not None:
                found[c].add(kind(v))
    return found


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, build, sql) -> str:
    got = build(spark, folder)
    columns = got.columns
    began = time.time()
    rows = [tuple(r) for r in got.collect()]
    took = f"{time.time() - began:.1f}s "
    if sql is None:
        return f"rows only: {len(rows)} {took}"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(columns) != sorted(names):
        return f"DIFFERENT columns {sorted(columns)} / {sorted(names)}"
    a, b = rows_of(columns, rows), rows_of(names, want)
    if a != b:
        only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
        return f"DIFFERENT rows {len(rows)} / {len(want)}: {only_a} / {only_b}"
    ka, kb = kinds(columns, rows), kinds(names, want)
    odd = {c: (ka[c], kb[c]) for c in ka if ka[c] != kb[c]}
    if not rows:
        return "EMPTY"
    return f"same ({len(rows)} rows) {took}" + (f" TYPES {odd}" if odd else "")


def main() -> int:
    import __spark_entry__ as entry

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            outcome = compare(spark, con, folder, build, sql.get(name))
        except Exception as error:  # report and go on with the next query
            outcome = "FAILED " + "".join(traceback.format_exception_only(error))[:1500]
        bad += not outcome.startswith(("same", "rows only"))
        print(f"{name:28s} {time.time() - start:6.2f}s {outcome}", flush=True)
    print("not right:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
