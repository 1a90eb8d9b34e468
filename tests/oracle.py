"""Compares a query's rows with the same rows computed by DuckDB."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        files = str(p / "*.parquet") if p.is_dir() else str(p)
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{files}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if type(x).__name__ == "Decimal":
        return float(f"{float(x):.9g}")
    if isinstance(x, list):
        return tuple(map(plain, x))
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(df, sql: str, sf_dir: str) -> int:
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(sf_dir).sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
    return len(got[1])
