"""Runs a query and its SQL over the same tables and compares columns, types and rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bytes | bytearray):
        return bytes(v).hex()
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return v


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


def differences(df, con, sql: str) -> list[str]:
    """Empty if both sides agree."""
    left = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = sorted_rows([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return [f"columns {left[0]} and {right[0]}"]
    if len(left[1]) != len(right[1]):
        return [f"{len(left[1])} and {len(right[1])} rows"] + [f"{x} | {y}" for x, y in list(zip(left[1], right[1], strict=False)) if x != y][:2]
    return [f"{x} | {y}" for x, y in zip(left[1], right[1], strict=True) if x != y][:3]
