"""Comparison of a query's rows with those of its SQL in DuckDB."""

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (datetime, date)):
        return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime) else v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows_of_sql(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    frame = con.execute(sql)
    names = [d[0] for d in frame.description]
    return names, frame.fetchall()


def assert_same(df, sql: str, sf_dir: str) -> None:
    names, expected = rows_of_sql(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in expected)
    assert len(ours) == len(theirs)
    assert ours == theirs
