"""Compares a query's rows with its oracle's."""

from __future__ import annotations

import datetime
import decimal
import math
import os


def norm(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(norm(r[k]) for k in order) for r in rows), key=repr)


def duck(folder):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        name, path = f.removesuffix(".parquet"), f"{folder}/{f}"
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def assert_same(df, sql, folder):
    got = table(df.columns, [tuple(r) for r in df.collect()])
    c = duck(folder).execute(sql)
    assert got == table([x[0] for x in c.description], c.fetchall())
