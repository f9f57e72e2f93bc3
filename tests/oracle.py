"""Compares a query's rows with those of its SQL."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(repr(tuple(plain(r[k]) for k in order)) for r in rows)


def same(df, db, sql):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = db.execute(sql)
    want = rows_of([d[0] for d in found.description], found.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
