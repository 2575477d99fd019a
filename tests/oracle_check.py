"""Compare a Spark result with a DuckDB result by columns, row count and values."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


# DuckDB type name by Spark type name.
SAME_TYPE = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "string": {"VARCHAR"},
    "date": {"DATE"},
    "boolean": {"BOOLEAN"},
    "double": {"DOUBLE"},
}


def differences(df, con, sql: str) -> list[str]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    found = [
        f"type of {name}: {kind} != {types[name]}"
        for name, kind in df.dtypes
        if types[name] not in SAME_TYPE.get(kind, set())
    ]
    actual = [tuple(r) for r in df.collect()]
    if len(actual) != len(expected):
        found.append(f"rows {len(actual)} != {len(expected)}")
    if not expected:
        found.append("no rows to compare")
    a, e = _bag(df.columns, actual), _bag(names, expected)
    if a != e:
        found.append(f"only in Spark: {list((a - e).items())[:2]}")
        found.append(f"only in DuckDB: {list((e - a).items())[:2]}")
    return found
