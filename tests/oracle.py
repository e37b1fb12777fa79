"""Runs a query in Spark and its SQL in DuckDB and compares them as multisets."""

import datetime as dt
import os
from collections import Counter

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, dt.datetime) and v.tzinfo:
        return v.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return str(v) if isinstance(v, (list, dict)) else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in values)


def same(df, con, sql: str) -> None:
    table = df.toArrow()
    got = rows(table.column_names, [tuple(r.values()) for r in table.to_pylist()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows(names, cur.fetchall())
    assert sorted(table.column_names) == sorted(names)
    assert got == want, f"only in Spark {list((got - want).items())[:3]}, only in SQL {list((want - got).items())[:3]}"
