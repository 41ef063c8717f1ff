"""Run a query and its oracle SQL over the same tables, and compare rows without regard to order."""

from __future__ import annotations

import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("SPANFRAME_DATA", "/root/testdata")


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def counted(names: list[str], rows: list) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, sql: str, sf_dir: str) -> list:
    """Rows of one side only, a few; the column names where these differ."""
    names, rows = oracle_rows(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return [("columns", sorted(df.columns), sorted(names))]
    ours, theirs = counted(df.columns, df.collect()), counted(names, rows)
    return [("ours", *x) for x in list((ours - theirs).items())[:3]] + [("theirs", *x) for x in list((theirs - ours).items())[:3]]
