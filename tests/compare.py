"""Rows of a query beside those of its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in data)


def differences(spark, query, sql: str, sf_dir: str, con) -> str:
    df = query(spark, sf_dir)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    out = con.execute(sql)
    b = rows([x[0] for x in out.description], out.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    left, right = a[1] - b[1], b[1] - a[1]
    return f"{sum(left.values())} rows only in Spark, {sum(right.values())} only in SQL: {list(left)[:2]} {list(right)[:2]}" if left or right else ""
