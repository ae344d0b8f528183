"""Runs registered queries and their SQL on the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if value is None or isinstance(value, (bool, str)):
        return repr(value)
    if isinstance(value, int):
        return f"{value:.15g}" if abs(value) < 1e9 else str(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26]
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def differences(spark, con, folder, query, sql):
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.sql(sql)
    want = rows(list(found.columns), found.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"{len(got[1])} and {len(want[1])} rows; only here {sorted(a - b)[:2]}; only there {sorted(b - a)[:2]}"
    return "" if got[1] else "no rows"
