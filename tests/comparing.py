"""Compare a Spark result with what DuckDB makes of the matching SQL."""

from __future__ import annotations

import math

import duckdb

from filingmill.sources.sample_views import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (int, float)):
        return round(float(v), 9)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs, at most a few lines; empty when the results are equal."""
    s_cols, s_rows = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    d_cols, d_rows = rows([d[0] for d in cur.description], cur.fetchall())
    if s_cols != d_cols:
        return [f"columns {s_cols} != {d_cols}"]
    found = [] if len(s_rows) == len(d_rows) else [f"{len(s_rows)} rows != {len(d_rows)} rows"]
    s_set, d_set = set(s_rows), set(d_rows)
    found += [f"only spark: {r}" for r in sorted(s_set - d_set, key=str)[:3]]
    found += [f"only sql:   {r}" for r in sorted(d_set - s_set, key=str)[:3]]
    return found
