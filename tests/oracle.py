"""Compare a query with its DuckDB SQL, as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(repr(tuple(norm(r[i]) for i in order)) for r in data)


def assert_same(df, sql, tables):
    """tables: name -> path of a Parquet file, or a pandas frame."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name, source in tables.items():
        if isinstance(source, str):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
        else:
            con.register(name, source)
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    want = rows(columns, found.fetchall())
    assert sorted(df.columns) == sorted(columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == want, (list((got - want))[:3], list((want - got))[:3])
