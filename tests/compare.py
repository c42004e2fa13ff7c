"""Run registered queries beside their SQL and compare schema, row count and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "float": "FLOAT", "array<int>": "INTEGER[]", "array<bigint>": "BIGINT[]", "array<double>": "DOUBLE[]"}


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, "nan" if isinstance(v, float) and math.isnan(v) else
                  tuple(v) if isinstance(v, list) else v) for v in row)


def check(spark, con, fn, sql: str | None, sf: str) -> str:
    """Empty when equal, otherwise what differs."""
    df = fn(spark, sf)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    if sql is None:
        return "" if got else "no rows"
    cur = con.execute(sql)
    names = {d[0]: (i, str(d[1])) for i, d in enumerate(cur.description)}
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    types = dict(df.dtypes)
    bad = [(c, types[c], names[c][1]) for c in cols if SAME.get(types[c], types[c]) != names[c][1]]
    if bad:
        return f"types {bad}"
    want = [tuple(r[names[c][0]] for c in cols) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for a, b in zip(sorted(got, key=_key), sorted(want, key=_key)):
        if _key(a) != _key(b):
            return f"{cols}: {a} vs {b}"
    return ""


def main(names, sf="/root/testdata/sf0.01"):
    import pathlib
    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from panoloom.session import local_session
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, q, o = connect(sf), entry.queries(), entry.oracle_sql()
    fails = 0
    for name in names or q:
        t = time.time()
        try:
            diff = check(spark, con, q[name], o.get(name), sf)
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        fails += bool(diff)
        print(f"{'ok  ' if not diff else 'FAIL'} {name:22s} {time.time() - t:6.2f}s {'' if name in o else '(rows only)'} {diff}", flush=True)
    print("failures:", fails)


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf = args.pop(0)
    main(args, sf)
