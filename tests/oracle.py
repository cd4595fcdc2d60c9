"""Runs a query and its SQL and compares the rows without regard to order."""

import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def close(a, b):
    if isinstance(a, float) and isinstance(b, float | int):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)
    return a == b


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def compare(df, sql, folder):
    names = sorted(df.columns)
    mine = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in names]).collect()), key=repr)
    cursor = connect(folder).execute(sql)
    there = [c[0] for c in cursor.description]
    assert sorted(there) == names
    at = [there.index(c) for c in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    assert len(mine) == len(theirs)
    assert all(close(x, y) for a, b in zip(mine, theirs, strict=True) for x, y in zip(a, b, strict=True))
