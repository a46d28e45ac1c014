"""Compare every registered query with its SQL on a data folder: python tests/check.py FOLDER [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from thetaloom.sources.tables import TABLES  # noqa: E402

#: The folder of the tests; a test module takes it from here, since each test folder has a conftest of its own.
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(folder: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return connection


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(row[i]) for i in order) for row in rows)


def spark_rows(frame):
    return rows_of(frame.columns, [tuple(row) for row in frame.collect()])


def duck_rows(connection, sql):
    names = [row[0] for row in connection.execute(f"describe {sql}").fetchall()]
    return rows_of(names, connection.execute(sql).fetchall())


def difference(left, right) -> str | None:
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}; " + _sample(left, right)
    return None if left[1] == right[1] else _sample(left, right)


def _sample(left, right):
    a, b = [r for r in left[1] if r not in set(right[1])], [r for r in right[1] if r not in set(left[1])]
    return f"{left[0]} {len(a)} differ\n   spark {a[:3]}\n   sql   {b[:3]}"


def main(folder: str, names: list[str]):
    import __spark_entry__ as entry
    from thetaloom.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    connection = duck(folder)
    failed = 0
    for name, run in queries.items():
        if names and not any(name.startswith(prefix) for prefix in names):
            continue
        started = time.time()
        try:
            left = spark_rows(run(spark, folder))
            took = time.time() - started
            if name not in oracles:
                print(f"rows  {name} {len(left[1])} rows {took:.1f}s", flush=True)
                continue
            started = time.time()
            right = duck_rows(connection, oracles[name])
            found = difference(left, right)
            print(f"{'ok   ' if found is None else 'DIFF '} {name} {len(left[1])} rows {took:.1f}s sql {time.time() - started:.1f}s {found or ''}", flush=True)
            failed += found is not None
            if not left[1]:
                print(f"EMPTY {name}")
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"FAIL  {name} {type(error).__name__}: {str(error)[:900]}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
