"""Compares a Spark result with the DuckDB result of the same query."""

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    connection = duckdb.connect()
    for table in TABLES:
        if os.path.exists(f"{folder}/{table}.parquet"):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in values), key=repr)


def compare(df, connection, sql):
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    want = rows(names, result.fetchall())
    assert sorted(df.columns) == sorted(names)
    got = rows(df.columns, df.collect())
    assert len(got) == len(want), f"{len(got)} rows, not {len(want)}"
    different = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not different, f"{len(different)} of {len(got)} differ: {different[:2]}"
