"""Rows of a query and of its SQL in one form."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import Row

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, Row):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return round(v, 6) if isinstance(v, float) else v


def of_frame(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def of_sql(sql: str, sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    r = c.sql(sql)
    names = sorted(r.columns)
    at = [r.columns.index(n) for n in names]
    return names, sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
