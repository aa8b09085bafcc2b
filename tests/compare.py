"""Compares each query with its SQL on small tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def same(spark, run, sql: str, folder: str) -> str:
    """Empty if both give the same rows, else what differs."""
    con = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = run(spark, folder)
    names = sorted(df.columns)
    cur = con.execute(sql)
    got_names = [c[0] for c in cur.description]
    if sorted(got_names) != names:
        return f"columns {names} and {sorted(got_names)}"
    order = [got_names.index(n) for n in names]
    want = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)
    have = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    if len(want) != len(have):
        return f"{len(have)} rows and {len(want)}"
    for a, b in zip(have, want, strict=True):
        if not all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b, strict=True)):
            return f"{a} and {b}"
    return ""
