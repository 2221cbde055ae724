"""Compares a query's rows with those of its SQL in DuckDB."""

import math
from pathlib import Path


def rows_of(names, rows):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "~"
        if isinstance(x, bool) or not isinstance(x, (int, float)):
            return str(x)
        return f"{float(x):.6f}"

    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same_as_duckdb(df, sql: str, sf: str) -> None:
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    found = con.execute(sql)
    want = rows_of([c[0] for c in found.description], found.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert got[1] == want[1]
