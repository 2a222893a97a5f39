"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import threading
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def norm(value):
    if hasattr(value, "item"):
        value = value.item()
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 9)
    if hasattr(value, "as_tuple"):
        return round(float(value), 9)
    if hasattr(value, "isoformat"):
        return value.isoformat().replace("T00:00:00", "")
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(con, spark, name, fn, sql, sf_dir):
    """(ok, message)"""
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.1f}s"
    limit = threading.Timer(90, con.interrupt)
    limit.start()
    try:
        cur = con.execute(sql)
        columns = [d[0] for d in cur.description]
        want = cur.fetchall()
    finally:
        limit.cancel()
    sql_took = time.time() - start - took
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = rows(df.columns, got), rows(columns, want)
    if a != b:
        diff = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return False, f"{len(a)} vs {len(b)} rows; spark only {str(diff[0])[:600]}; sql only {str(diff[1])[:600]}"
    return True, f"{len(a)} rows, {took:.1f}s, sql {sql_took:.1f}s"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from policylake.session import build_session
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if args and not any(a in name for a in args):
            continue
        try:
            ok, message = compare(con, spark, name, fn, sqls.get(name), sf_dir)
        except Exception as e:
            ok, message = False, f"{type(e).__name__}: {str(e)[:1200]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, message, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
