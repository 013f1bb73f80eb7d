"""Comparison of a query with its SQL on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb


def shown(value: object) -> str:
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return str([shown(v) for v in value])
    return str(value)


def same(columns: list[str], rows: list, sql: str, folder: str) -> None:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    want = got.fetchall()
    assert sorted(columns) == sorted(names)
    mine = sorted(tuple(shown(r[c]) for c in sorted(names)) for r in rows)
    other = sorted(tuple(shown(r[names.index(c)]) for c in sorted(names)) for r in want)
    assert mine == other
