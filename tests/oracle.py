"""Holding a query against its SQL on DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb


def plain(value):
    if value is None or value != value:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list):
        return str(value)
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows(frame, columns):
    return sorted(str(tuple(plain(v) for v in r)) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None))


def held_against_sql(spark, sf_dir, query, sql):
    got = query(spark, sf_dir).toPandas()
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = con.execute(sql).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
