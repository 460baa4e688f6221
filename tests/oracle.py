"""Runs SQL over the driver tables in DuckDB and compares rows."""

from __future__ import annotations

from pathlib import Path

import duckdb


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, dict):
        return str({k: plain(v) for k, v in sorted(value.items())})
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return repr(0.0 if value == 0 and isinstance(value, float) else value)


def rows_of(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted(tuple(plain(r[c]) for c in names) for r in df.collect())


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    names = sorted(columns)
    places = [columns.index(n) for n in names]
    return names, sorted(tuple(plain(r[i]) for i in places) for r in found.fetchall())
