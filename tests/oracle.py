"""Runs a query and its DuckDB text over the same tables and compares the rows."""

from __future__ import annotations

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def order(row):
    """Rows sort by what isn't a float, then by rounded floats, so that a last digit doesn't move them."""
    return repr([v for v in row if not isinstance(v, float)]), [round(v, 2) for v in row if isinstance(v, float)]


def rows_of_spark(df, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=order)


def rows_of_duckdb(con, sql, columns):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns, (sorted(names), columns)
    return sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=order)


def digits(v):
    """Decimals that a number is written with, up to 12."""
    text = repr(v)
    return len(text.partition(".")[2]) if "e" not in text else 12


def same(a, b, scales):
    """Equal, or floats a last rounded digit of their column apart (sums of floats depend on their order)."""
    near = lambda x, y, n: math.isclose(x, y, rel_tol=1e-9, abs_tol=1.5 * 10.0**-n)
    return len(a) == len(b) and all(x == y or isinstance(x, float) and isinstance(y, float) and near(x, y, n) for x, y, n in zip(a, b, scales, strict=True))


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    got, want = rows_of_spark(df, columns), rows_of_duckdb(con, sql, columns)
    assert len(got) == len(want)
    scales = [min(12, max((digits(r[i]) for r in want if isinstance(r[i], float)), default=12)) for i in range(len(columns))]
    assert not (bad := [(a, b) for a, b in zip(got, want, strict=True) if not same(a, b, scales)]), bad[:2]
