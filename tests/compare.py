"""Runs a registered query and its SQL and compares the rows."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    flat = [tuple(round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(flat, key=repr)


def difference(df, con, sql: str) -> str:
    """Empty if both give the same rows."""
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want = _rows([c[0] for c in rel.description], rel.fetchall())
    if sorted(df.columns) != sorted(c[0] for c in rel.description):
        return f"columns {df.columns} {[c[0] for c in rel.description]}"
    odd = [(a, b) for a, b in zip(got, want, strict=False) if a != b]
    return f"{len(got)} rows against {len(want)}; {len(odd)} differ: {odd[:2]}" if odd or len(got) != len(want) else ""
