"""Comparing a query's rows with its DuckDB twin's."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6))
    return str(x)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def expected(sql, sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = c.execute(sql)
    return canonical([d[0] for d in cursor.description], cursor.fetchall())


def actual(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])
