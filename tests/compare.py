"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    db = duckdb.connect()
    for path in sorted(glob.glob(os.path.join(sf_dir, "*.parquet"))):
        name = os.path.basename(path)[: -len(".parquet")]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


def difference(df, db, sql):
    """None if equal, else a short text."""
    result = db.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    got, want = _rows(df.columns, df.collect()), _rows(columns, result.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}; only here {list(set(got) - set(want))[:2]}; only there {list(set(want) - set(got))[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"row {a} != {b}"
    return None
