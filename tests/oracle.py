"""Runs a query's SQL with DuckDB and compares it with the Spark rows, as sets of rows with columns in name order."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, int):
        return float(v)
    return v


def rows(names: list[str], data) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def difference(spark, sf_dir: str, plan, sql: str) -> tuple[list[str], list[str], list, list]:
    df = plan(spark, sf_dir)
    cur = connection(sf_dir).execute(sql)
    names = [c[0] for c in cur.description]
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, cur.fetchall())
    return sorted(df.columns), sorted(names), list((got - want).items())[:3], list((want - got).items())[:3]
