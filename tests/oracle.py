"""Runs a query and its SQL over the same tables and compares the rows."""

import glob
import math
import os
from collections import Counter

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(_value, x))
    if isinstance(x, (bytearray, bytes)):
        return bytes(x)
    return getattr(x, "isoformat", lambda: x)()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_value(r[i]) for i in order) for r in rows)


def duck(sql, sf_dir=SF, **views):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    for name, frame in views.items():
        con.register(f"{name}_", frame)
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {name}_")
    found = con.execute(sql)
    return rows_of([c[0] for c in found.description], found.fetchall())


def assert_same(df, sql, sf_dir=SF, **views):
    columns, mine = rows_of(df.columns, df.collect())
    their_columns, theirs = duck(sql, sf_dir, **views)
    assert columns == their_columns
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
    return sum(mine.values())
