"""Run the named queries and their SQL side by side: `python tests/compare.py [sf_dir] [name ...]`."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

from glossaframe.plans.registry import TABLES, path_of


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path_of(sf_dir, table)}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(made, key=repr)


def spark_side(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_side(con, sql):
    cursor = con.execute(sql)
    return rows_of([d[0] for d in cursor.description], cursor.fetchall())


def differences(spark_result, sql_result) -> str | None:
    (columns, mine), (expected_columns, expected) = spark_result, sql_result
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if len(mine) != len(expected):
        return f"{len(mine)} rows, expected {len(expected)}"
    for a, b in zip(mine, expected):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} != {b}"
    return None


def main() -> int:
    from glossaframe import local_session
    from glossaframe.plans import QUERIES, SQL

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, bad = local_session(8), connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            result = spark_side(QUERIES[name](spark, sf_dir))
            took = time.time() - start
            problem = differences(result, sql_side(con, SQL[name])) if name in SQL else None
            print(f"{'FAIL' if problem else 'ok  '} {name:32s} {len(result[1]):7d} rows {took:6.2f}s {problem or ''}"[:600], flush=True)
            bad += bool(problem)
        except Exception as error:
            bad += 1
            text = traceback.format_exc() if len(names) <= 3 else str(error)[:500]
            print(f"FAIL {name:32s} {text}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
