"""Holds a query against its SQL: row count, column names and values, in any order."""

from __future__ import annotations

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    if x is None or (isinstance(x, float) and np.isnan(x)):
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(_plain(y) for y in x)
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (float, np.floating)):
        return float(x) + 0.0
    if isinstance(x, (int, np.integer)):
        return int(x)
    return str(x) if not isinstance(x, str) else x


def _order(row) -> str:
    return repr(tuple(f"{x:.3f}" if isinstance(x, float) else x for x in row))


def _same(a, b) -> bool:
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_same(x, y) for x, y in zip(a, b))
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-6 * max(1.0, abs(a), abs(b))
    return a == b


def differences(df, con, sql: str) -> str:
    """Empty if both sides have the same rows."""
    cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = sorted((tuple(_plain(r[k]) for k in order) for r in cur.fetchall()), key=_order)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=_order)
    if len(want) != len(got):
        return f"{len(got)} rows against {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if not _same(g, w)]
    return f"{len(bad)} of {len(got)} rows differ, such as {bad[0]} of {cols}" if bad else ""
