"""Runs a query and its SQL twin and tells how they differ."""

import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{f}"
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def text(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, float):
        return f"{x + 0.0:.6g}"
    if hasattr(x, "item"):
        return text(x.item())
    return str(x)


def difference(spark, query, sql, sf_dir):
    got = query(spark, sf_dir)
    cur = connect(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    a = sorted(tuple(text(r[n]) for n in sorted(names)) for r in got.collect())
    order = [names.index(n) for n in sorted(names)]
    b = sorted(tuple(text(r[k]) for k in order) for r in cur.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, such as {wrong[0]}" if wrong else ""
