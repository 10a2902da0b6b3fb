"""Spark's rows against DuckDB's, whatever their order."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

from tests.conftest import TABLES


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, Decimal):
        return float(f"{float(x):.9g}")
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def expected(sql, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    out = c.sql(sql)
    return sorted(out.columns), rows(out.columns, out.fetchall()), {n: str(t) for n, t in zip(out.columns, out.types, strict=True)}


def same(df, sql, sf_dir):
    columns, want, _ = expected(sql, sf_dir)
    assert sorted(df.columns) == columns
    got = rows(df.columns, df.collect())
    assert len(got) == len(want)
    assert got == want
    return len(got)
