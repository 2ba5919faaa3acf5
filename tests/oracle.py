"""Runs a query and its SQL and compares them as sets of rows."""

import os

import duckdb


def connect(folder: str):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(folder):
        p = f"{folder}/{f}"
        c.execute(f"create view {f.split('.')[0]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, float) or hasattr(v, "quantize"):
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


def assert_same(df, con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows(names, r.fetchall())
