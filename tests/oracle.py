"""Rows of a query and of its oracle, in one comparable form."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v if isinstance(v, (int, bool, str, type(None))) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def from_duckdb(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.sql(sql)
    return sorted(found.columns), rows(found.columns, found.fetchall())


def from_spark(df):
    return sorted(df.columns), rows(df.columns, df.collect())
