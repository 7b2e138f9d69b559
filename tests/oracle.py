"""Compare a query with its SQL on the same parquet tables."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    return v


def _key(row):
    return tuple((v is None, str(type(v)) if v is None else "", repr(v)) for v in row)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=_key)


def compare(df, con, sql: str) -> list[str]:
    """Differences, at most a few; an empty list means equal."""
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_names, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_names != want_names:
        return [f"columns {got_names} != {want_names}"]
    if len(got) != len(want):
        only = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return [f"{len(got)} rows != {len(want)}", f"ours: {only[0]}", f"sql: {only[1]}"]
    bad = [f"{got_names}: {g} != {w}" for g, w in zip(got, want) if g != w]
    return bad[:3]
