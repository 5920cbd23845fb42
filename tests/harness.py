"""Compare a registered query with its DuckDB SQL the way the driver does."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        files = sorted(glob.glob(f"{path}/*.parquet")) if os.path.isdir(path) else [path]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet({files})")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.9g}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.9g}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(plain(row[i]) for i in order)) for row in values)


def assert_same(spark, query, sql: str, sf_dir: str) -> int:
    frame = query(spark, sf_dir)
    mine = rows(frame.columns, [tuple(r) for r in frame.collect()])
    connection = duck(sf_dir)
    result = connection.execute(sql)
    theirs = rows([c[0] for c in result.description], result.fetchall())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    different = [(a, b) for a, b in zip(mine[1], theirs[1], strict=True) if a != b]
    assert not different, different[:3]
    return len(mine[1])
