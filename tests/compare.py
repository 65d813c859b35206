"""Runs a query and its SQL side by side and compares them regardless of row order."""

from pathlib import Path

import duckdb

from millrace.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def norm(v):
    return round(v, 9) if isinstance(v, float) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([norm(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> int:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    want = rows_of(names, out.fetchall())
    assert got == want, (got[:3], want[:3], len(got), len(want))
    return len(got)
