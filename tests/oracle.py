"""Compare one registered query with its SQL in DuckDB, column by column."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((v is not None, round(v, 4) if isinstance(v, float) else str(v)) if not isinstance(v, float)
                 else (True, f"{v:.4f}") for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return type(a) is type(b) and a == b


def difference(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    rel = con.execute(sql)
    names = sorted(d[0] for d in rel.description)
    at = {d[0]: i for i, d in enumerate(rel.description)}
    want = sorted((tuple(r[at[n]] for n in names) for r in rel.fetchall()), key=_key)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} != {names}"
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=_key)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if not all(map(_same, g, w))]
    return f"{len(bad)}/{len(got)} rows differ; columns {names}; first {bad[0]}" if bad else None
