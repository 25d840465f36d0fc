"""Run reports on Spark and their checks in DuckDB, and compare the rows.

    python -m tests.compare [--sf 0.01] [report ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from courierworks.catalog import CHECKS, REPORTS
from courierworks.session import build_session
from courierworks.sources.adapters import TABLES, Views


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(plain(rec[i]) for i in order) for rec in records]
    return [columns[i] for i in order], sorted(rows, key=lambda row: tuple((v is None, str(type(v)), str(v)) for v in row))


def compare(name: str, spark, con, folder: str) -> str | None:
    """None when equal, else what differs."""
    df = REPORTS[name](Views(spark, folder))
    columns, rows = rows_of(df.columns, df.collect())
    if name not in CHECKS:
        return None if rows else "no rows"
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    types = {row[0]: row[1] for row in con.execute("DESCRIBE " + CHECKS[name]).fetchall()}
    odd = [(f.name, f.dataType.simpleString(), types.get(f.name)) for f in df.schema.fields
           if kinds.get(f.dataType.simpleString()) != types.get(f.name)]
    result = con.execute(CHECKS[name])
    want_columns, want = rows_of([d[0] for d in result.description], result.fetchall())
    if columns != want_columns:
        return f"columns {columns} != {want_columns}"
    if len(rows) != len(want):
        return f"{len(rows)} rows, expected {len(want)}; only here: {list(set(rows) - set(want))[:2]}; only there: {list(set(want) - set(rows))[:2]}"
    if rows != want:
        a, b = list(set(rows) - set(want)), list(set(want) - set(rows))
        return f"{len(a)} of {len(rows)} rows differ, {columns}: {sorted(a, key=str)[:2]} expected {sorted(b, key=str)[:2]}"
    return f"types {odd}" if odd else None


def main(argv: list[str]) -> int:
    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in argv or list(REPORTS):
        start = time.time()
        try:
            problem = compare(name, spark, con, folder)
        except Exception as error:  # report every failure, then go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        kind = "" if name in CHECKS else " (rows only)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name}{kind} {time.time() - start:.1f}s {problem or ''}", flush=True)
        bad += problem is not None
    print(f"{bad} failed")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
