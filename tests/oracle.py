"""Runs a registered query and its check SQL and compares the results."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}") + 0.0
    if hasattr(value, "asDict"):
        return tuple(norm(v) for v in value.asDict().values())
    if isinstance(value, dict):
        return tuple(sorted((k, norm(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)


def kinds(row):
    return [type(norm(v)).__name__ for v in row]


def compare(df, sql, con):
    """Returns (ok, message)."""
    rel = con.sql(sql)
    want_cols, want_rows = list(rel.columns), rel.fetchall()
    got_cols = list(df.columns)
    got_rows = [tuple(r) for r in df.collect()]
    if sorted(got_cols) != sorted(want_cols):
        return False, f"columns {sorted(got_cols)} vs {sorted(want_cols)}"
    got, want = rows_of(got_cols, got_rows), rows_of(want_cols, want_rows)
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}"
    if got != want:
        gs, ws = set(got), set(want)
        bad = [(a, b) for a, b in zip(sorted(gs - ws), sorted(ws - gs))][:2]
        return False, f"{len(gs - ws)} of {len(got)} rows differ, e.g. {bad}"
    return True, f"{len(got)} rows"
