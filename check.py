"""Run registered queries next to their SQL on the same tables and compare the rows.

    python check.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

from cohortlens import catalog
from cohortlens.runtime import get_session


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, Decimal)):
        return repr(float(v))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, con, name, fn, sql, sf):
    start = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return "rows" if got else "EMPTY", f"{len(got)} rows", took
    rel = con.sql(sql)
    want = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return "FAIL", f"columns {sorted(df.columns)} vs {sorted(rel.columns)}", took
    a, b = rows_of(df.columns, got), rows_of(rel.columns, want)
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    odd = {c: (t, kinds[c]) for c, t in df.dtypes if TYPES.get(t) != kinds[c]}
    if a == b and odd:
        return "TYPE", str(odd), took
    if a == b:
        return "ok" if got else "EMPTY", f"{len(a)} rows", took
    diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return "FAIL", f"{len(a)} vs {len(b)} rows; {diff} ; types {df.dtypes} {[str(t) for t in rel.types]}", took


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    queries, oracles = catalog.load()
    spark = get_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for path in glob.glob(f"{args.sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    bad = 0
    for name, fn in queries.items():
        if args.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        try:
            state, note, took = compare(spark, con, name, fn, oracles.get(name), args.sf)
        except Exception as exc:  # report and go on with the next query
            state, note, took = "ERROR", f"{type(exc).__name__}: {str(exc)[:1500]}", 0.0
        bad += state in ("FAIL", "ERROR", "EMPTY", "TYPE")
        print(f"{state:6} {took:6.2f}s {name}: {note}", flush=True)
    print(f"{bad} bad", flush=True)
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
