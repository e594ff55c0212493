"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

``python -m checks.compare [sf_dir] [query ...]``
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path


def duckdb_tables(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int) or type(value).__name__ == "Decimal":
        return repr(float(value))
    return str(value)


def canonical(columns, rows) -> tuple:
    """Column names in order and the rows as sorted plain values."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (
        [columns[i] for i in order],
        sorted(tuple(_plain(row[i]) for i in order) for row in rows),
    )


def differences(spark_df, connection, sql: str) -> str:
    """Empty when both give the same columns and rows."""
    got = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    want = canonical(names, result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        pairs = [(g, w) for g, w in zip(got[1], want[1]) if g != w][:3]
        return f"{len(got[1])} rows, expected {len(want[1])}; first differences {pairs}"
    return ""


def main(sf_dir: str, wanted: list) -> int:
    from checks.oracle import ORACLE
    from checks.queries import QUERIES
    from curbmeter.session import build_session

    spark = build_session(master="local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb_tables(sf_dir)
    failed = 0
    for name in wanted or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            problem = differences(df, connection, ORACLE[name]) if name in ORACLE else f"({df.count()} rows)"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad = bool(problem) and not problem.startswith("(")
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name:28s} {time.time() - start:6.2f}s {problem}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    arguments = sys.argv[1:]
    sys.exit(main(arguments[0] if arguments else "/root/testdata/sf0.001", arguments[1:]) > 0)
