"""Rows of a query and of its SQL, ready to be compared."""

from __future__ import annotations

import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "asDict"):
        v = tuple(v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def spark_rows(df):
    names = sorted(df.columns)
    return names, ordered([tuple(plain(r[c]) for c in names) for r in df.collect()])


def duck_rows(sql, sf_dir=DATA):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    done = con.execute(sql)
    found = [d[0] for d in done.description]
    names = sorted(found)
    at = [found.index(n) for n in names]
    return names, ordered([tuple(plain(r[i]) for i in at) for r in done.fetchall()])
