"""Run registered queries next to their SQL and report differences.

Usage: python tests/check_oracle.py FOLDER [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def _ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(frame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a frame and its statement: columns, row count, values."""
    relation = con.sql(sql)
    want_columns, want = _ordered(relation.columns, relation.fetchall())
    have_columns, have = _ordered(frame.columns, [tuple(r) for r in frame.collect()])
    if have_columns != want_columns:
        return [f"columns {have_columns} != {want_columns}"]
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    other = {c: (t, kinds[c]) for c, t in frame.dtypes if TYPES.get(t) != kinds[c]}
    if other:
        return [f"types {other}"]
    found = [] if len(have) == len(want) else [f"rows {len(have)} != {len(want)}"]
    wrong = [(h, w) for h, w in zip(have, want) if h != w]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first {str(wrong[0])[:600]}")
    return found


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from condeval.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con, sql = local_session(8), connect(folder), oracle_sql()
    bad = 0
    for name, query in queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            frame = query(spark, folder)
            found = differences(frame, con, sql[name]) if name in sql else ["no SQL"]
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        print(f"{name:28s} {time.time() - start:6.2f}s {'ok' if not found else found}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
