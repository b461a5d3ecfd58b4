"""Run registered queries in Spark and their SQL in DuckDB and compare all rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 9)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canon(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf):
    df = fn(spark, sf)
    sc, sr = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    dc, dr = rows([d[0] for d in cur.description], cur.fetchall())
    if sc != dc:
        return f"columns differ: {sc} {dc}"
    if len(sr) != len(dr):
        return f"row counts differ: {len(sr)} {len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"{len(bad)} of {len(sr)} rows differ, first: {sc} {bad[0][0]} {bad[0][1]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from tests.conftest import session
    import __spark_entry__ as E

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = session(), duck(sf)
    q, o = E.queries(), E.oracle_sql()
    names = sys.argv[1:] or list(q)
    for n in names:
        t = time.time()
        try:
            if n in o:
                res = compare(spark, con, n, q[n], o[n], sf) or "ok"
            else:
                res = f"rows only: {q[n](spark, sf).count()}"
        except Exception as e:  # noqa: BLE001
            res = "ERROR " + str(e).split("JVM stacktrace")[0][:600]
        print(f"{n:24s} {time.time() - t:6.1f}s  {res}", flush=True)
