"""Runs a registered query and its SQL on the same tables and compares all values.

As a script: ``python tests/oracle.py [sf_dir] [query ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import datetime

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_plain(row[i]) for i in order] for row in rows), key=repr)


TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
              "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when the results agree, else what differs."""
    from tallygrid.plans.catalog import QUERIES, SQL

    frame = QUERIES[name](spark, sf_dir)
    mine = _rows(frame.columns, frame.collect())
    if name not in SQL:
        return None
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    theirs = _rows(columns, cursor.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} vs {sorted(columns)}"
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    for column, kind in frame.dtypes:
        if TYPE_NAMES.get(kind, kind) != kinds[column]:
            return f"type of {column}: {kind} vs {kinds[column]}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows vs {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{sorted(frame.columns)}: {a} vs {b}"
    return None if mine or "allow_empty" in name else "no rows"


if __name__ == "__main__":
    from tallygrid import build_session
    from tallygrid.plans.catalog import QUERIES, SQL

    arguments = sys.argv[1:]
    sf = arguments.pop(0) if arguments and arguments[0].startswith("/") else "/root/testdata/sf0.01"
    session, connection = build_session(), connect(sf)
    bad = 0
    for query_name in arguments or list(QUERIES):
        began = time.time()
        try:
            difference = compare(session, connection, query_name, sf)
        except Exception as error:  # noqa: BLE001  (report and go on with the next query)
            difference = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += difference is not None
        checked = "sql" if query_name in SQL else "rows"
        print(f"{'ok ' if difference is None else 'BAD'} {checked} {time.time() - began:6.2f}s {query_name} {difference or ''}", flush=True)
    print("differences:", bad)
