"""Run registered queries next to their SQL: python -m tests.parity [--sf DIR] [name-prefix ...]."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .appName("threadloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int,)):
        return v
    try:
        f = float(v)
        if not isinstance(v, str):
            return None if math.isnan(f) else round(f, 5) + 0.0
    except (TypeError, ValueError):
        pass
    return str(v)


def bag(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "int64", "int": "int32", "double": "double", "string": "string", "boolean": "bool"}
DUCK = {"BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "bool"}


def check(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(rows)} rows, {t1 - t0:.1f}s", True
    cur = con.execute(sql)
    want = cur.fetchall()
    cols = [d[0] for d in cur.description]
    types = {d[0]: DUCK.get(str(d[1]), str(d[1])) for d in cur.description}
    got_types = {c: KINDS.get(k, k) for c, k in df.dtypes}
    t2 = time.time()
    tag = f"{len(rows)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS differ: {sorted(df.columns)} vs {sorted(cols)}", False
    a, b = bag(rows, df.columns), bag(want, cols)
    if a != b:
        extra, miss = list((a - b).items())[:4], list((b - a).items())[:4]
        return f"VALUES differ ({len(rows)} vs {len(want)} rows)\n   cols {sorted(cols)}\n   spark only {extra}\n   sql only   {miss}", False
    if types != got_types:
        odd = {c: (got_types[c], types[c]) for c in types if types[c] != got_types[c]}
        return f"ok but types differ {odd}; {tag}", True
    return f"ok {tag}", True


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con = session(), connect(args.sf)
    bad = []
    for name, fn in queries.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        try:
            note, good = check(spark, con, args.sf, name, fn, oracles.get(name))
        except Exception as e:  # keep going, report at the end
            note, good = f"ERROR {type(e).__name__}: {str(e)[:1500]}", False
        if not good:
            bad.append(name)
        print(f"{name}: {note}", flush=True)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
