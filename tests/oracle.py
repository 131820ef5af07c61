"""Compare registered queries with their SQL in DuckDB on the same files.

Run ``python -m tests.oracle <folder> [query ...]`` for a report with timings.
"""

from __future__ import annotations

import sys
import time
from datetime import datetime
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def canonical(value):
    if isinstance(value, float):
        return None if value != value else (0.0 if value == 0 else value)
    if isinstance(value, datetime):
        return value.isoformat()
    return value


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def differences(spark: SparkSession, con, folder: str, fn, sql: str) -> str | None:
    """None when names, rows and values agree, else a short description."""
    df = fn(spark, folder)
    got = sorted_rows(df.columns, df.collect())
    result = con.sql(sql)
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {sorted(df.columns)} != {sorted(result.columns)}"
    want = sorted_rows(result.columns, result.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ, first {wrong[0]}"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    twins = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
    typed = {n: str(t) for n, t in zip(result.columns, result.types, strict=True)}
    odd = {n: (t, typed[n]) for n, t in types.items() if twins.get(t, t) != typed[n]}
    return f"types {odd}" if odd else None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from slotwise.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), connect(folder)
    failed = 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            sql = oracle_sql().get(name)
            if sql is None:
                note = f"{fn(spark, folder).count()} rows, no oracle"
                bad = False
            else:
                found = differences(spark, con, folder, fn, sql)
                bad, note = found is not None, found or "ok"
        except Exception as error:  # report and go on with the next query
            bad, note = True, f"{type(error).__name__}: {str(error)[:700]}"
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name:28s} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
