"""Run a registered query and its SQL on the same tables and compare the rows."""

import datetime
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
DATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(out, key=repr)


# Spark type -> type of the same column in the SQL result.
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
         "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def compare(spark, key, query, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    frame = query(spark, sf_dir)
    left = normal(frame.columns, [tuple(r) for r in frame.collect()])
    con = duck(sf_dir)
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    wrong = [(c, t, kinds.get(c)) for c, t in frame.dtypes if TYPES.get(t) != kinds.get(c)]
    if wrong:
        return f"{key}: types {wrong}"
    found = con.execute(sql)
    right = normal([d[0] for d in found.description], found.fetchall())
    if left[0] != right[0]:
        return f"{key}: columns {left[0]} vs {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{key}: {len(left[1])} vs {len(right[1])} rows"
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if bad:
        return f"{key}: {len(bad)} of {len(left[1])} rows differ, e.g. {bad[0][0]} vs {bad[0][1]}"
    if not left[1]:
        return f"{key}: empty"
    return None
