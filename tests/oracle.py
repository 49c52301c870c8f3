"""Comparing a query's rows with those of its SQL."""

from __future__ import annotations

import decimal
import glob
import math
import os

SF = "/root/testdata/sf0.001"


def views(folder: str = SF):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def _one(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 5) + 0.0
    return str([_one(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def rows(table) -> list[str]:
    columns = sorted(table.column_names)
    return sorted(str(tuple(map(_one, r))) for r in zip(*(table.column(c).to_pylist() for c in columns)))


def same(spark, query, sql: str, folder: str = SF) -> None:
    ours, theirs = query(spark, folder).toArrow(), views(folder).execute(sql).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert rows(ours) == rows(theirs)
