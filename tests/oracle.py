"""Compare a registered query with its SQL in DuckDB."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

from tallyframe.queries import REGISTRY
from tallyframe.queries.registry import NAMES


def connect(folder: str):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(v):
    if isinstance(v, Decimal):
        return ("decimal", str(v))
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, float):
        return ("float", "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0))
    return (type(v).__name__, str(v))


def _table(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted(tuple(_cell(r[i]) for i in at) for r in rows)


def differences(spark, con, folder: str, name: str) -> list[str]:
    df = REGISTRY[name](spark, folder)
    s_names, s_rows = _table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(REGISTRY[name].sql)
    d_names, d_rows = _table([c[0] for c in cursor.description], cursor.fetchall())
    found = []
    if s_names != d_names:
        return [f"columns {s_names} / {d_names}"]
    if len(s_rows) != len(d_rows):
        found.append(f"rows {len(s_rows)} / {len(d_rows)}")
    if s_rows != d_rows:
        mine, theirs = set(s_rows), set(d_rows)
        found += [f"only spark: {r}" for r in sorted(mine - theirs)[:3]] + [f"only sql:   {r}" for r in sorted(theirs - mine)[:3]]
        found = found or ["multiplicities differ"]
    return found
