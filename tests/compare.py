"""Run queries and their SQL twins side by side.

``python tests/compare.py [--sf 0.01] [key ...]``
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value: object) -> object:
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and value == int(value) if isinstance(value, float) and math.isfinite(value) else False:
        return int(value)
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return value


def normalized(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    out.sort(key=lambda row: tuple((value is not None, str(type(value)), str(value)) for value in row))
    return [columns[i] for i in order], out


def difference(spark_df, twin: str, con: duckdb.DuckDBPyConnection) -> str | None:
    """None when both sides agree, else a short description."""
    got_rows = [tuple(row) for row in spark_df.collect()]
    got_columns, got = normalized(spark_df.columns, got_rows)
    cursor = con.execute(twin)
    want_columns, want = normalized([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for left, right in zip(got, want):
        if left != right:
            parts = [(c, a, b) for c, a, b in zip(got_columns, left, right) if a != b]
            return "; ".join(f"{c}: {str(a)[:120]!r} != {str(b)[:120]!r}" for c, a, b in parts[:3])
    return None if got else "no rows on either side"


def main() -> int:
    from voxledger.catalog import load
    from voxledger.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("keys", nargs="*")
    args = parser.parse_args()
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = f"/root/testdata/sf{args.sf}"
    registry, con, bad = load(), duck(sf_dir), 0
    for key in args.keys or registry.queries:
        started = time.time()
        try:
            df = registry.queries[key](spark, sf_dir)
            if key in registry.twins:
                result = difference(df, registry.twins[key], con)
            else:
                result = None if df.count() else "no rows"
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:600]}"
        bad += result is not None
        print(f"{'ok ' if result is None else 'BAD'} {key} {time.time() - started:.1f}s {result or ''}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
