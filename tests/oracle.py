"""Spark-vs-DuckDB comparison used by the tests (mirrors the driver's check: row count, column names
and an order-insensitive comparison of the values)."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    """Exact comparison: floats must be bit-identical (both sides round where the SQL says so)."""
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark_df, con, sql):
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}")
        return problems
    d_types = dict(zip(d_cols, [str(t) for t in con.sql(sql).types]))
    for f in spark_df.schema.fields:
        st = f.dataType.simpleString()
        if _TYPES.get(st, st) != d_types[f.name]:
            problems.append(f"type of {f.name}: spark={st} duck={d_types[f.name]}")
    if len(s_rows) != len(d_rows):
        problems.append(f"row count spark={len(s_rows)} duck={len(d_rows)}")
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if a != b:
        in_a, in_b = set(map(repr, a)), set(map(repr, b))
        diff_a = [r for r in a if repr(r) not in in_b][:5]
        diff_b = [r for r in b if repr(r) not in in_a][:5]
        problems.append(f"values differ ({sorted(s_cols)}): spark-only={diff_a} duck-only={diff_b}")
    return problems
