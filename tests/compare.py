"""Side-by-side runs of a registered query and its DuckDB statement."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _kind(values) -> str:
    kinds = {type(v).__name__ for v in values if v is not None}
    return "/".join(sorted(kinds)) or "null"


def differences(con, sql: str, df) -> str | None:
    """None when columns, value types and row multisets agree."""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rel.fetchall()
    have = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = [df.columns.index(n) for n in names]
    have = [tuple(r[i] for i in order) for r in have]
    if len(have) != len(want):
        return f"{len(have)} rows, expected {len(want)}"
    for i, name in enumerate(names):
        mine, theirs = _kind(r[i] for r in have), _kind(r[i] for r in want)
        if mine != theirs:
            return f"column {name} is {mine}, expected {theirs}"
    left, right = Counter(have), Counter(want)
    if left != right:
        return f"only here {list((left - right).items())[:3]}, only expected {list((right - left).items())[:3]} ({names})"
    return None
