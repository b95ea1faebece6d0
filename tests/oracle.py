"""Compare a query with its SQL on the smallest tables, rows in any order."""

import math
import os

import duckdb

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def connection(tables=TABLES):
    found = duckdb.connect()
    for name in sorted(os.listdir(tables)):
        files = f"{tables}/{name}/*.parquet" if os.path.isdir(f"{tables}/{name}") else f"{tables}/{name}"
        found.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{files}'")
    return found


def same(spark, query, sql, tables=TABLES):
    frame = query(spark, tables)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(map(plain, row))) for row in frame.select(*columns).collect())
    told = connection(tables).sql(sql)
    assert sorted(told.columns) == columns
    order = [told.columns.index(c) for c in columns]
    want = sorted(repr(tuple(plain(row[k]) for k in order)) for row in told.fetchall())
    assert got == want
