"""Run a registered query in Spark and its SQL in DuckDB, and compare."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> str:
    """Empty when both sides agree, else what differs."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    want = _rows(names, result.fetchall())
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    have = _rows(spark_df.columns, spark_df.collect())
    if have == want:
        return "" if have else "both empty"
    extra, missing = list((have - want).items())[:2], list((want - have).items())[:2]
    return f"rows {sum(have.values())} vs {sum(want.values())}; only Spark {extra}; only SQL {missing}"
