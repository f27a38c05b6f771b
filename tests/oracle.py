"""Compare a query with its SQL on the same parquet tables.

Usage: python tests/oracle.py [sf] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = "/root/testdata"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


KIND = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
        "boolean": "BOOLEAN", "date": "DATE"}


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want_cols, want = rows_of(names, cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    for c, t in df.dtypes:
        if KIND.get(t, t) != types[c]:
            return f"type of {c}: spark {t}, sql {types[c]}"
    if len(got) != len(want):
        return f"{len(got)} rows, sql {len(want)}; first {got[:2]} | {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}"
    if not got:
        return "no rows"
    return None


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from conftest import make_spark

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0][0].isdigit() else "0.01"
    sf_dir = f"{ROOT}/sf{sf}"
    spark = make_spark()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(n.startswith(a) for a in args)]
    failed = 0
    for n in names:
        t0 = time.time()
        try:
            if n in oracles:
                problem = compare(spark, con, sf_dir, queries[n], oracles[n])
            else:
                rows = queries[n](spark, sf_dir).collect()
                problem = None if rows else "no rows"
                if args and rows:
                    print("   ", *[str(r)[:300] for r in rows[:5]], sep="\n    ")
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        mark = "FAIL" if problem else ("ok" if n in oracles else "rows")
        print(f"{mark:5s}{time.time() - t0:7.2f}s {n} {problem or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
