"""Comparison of a query with its SQL in DuckDB."""

import glob
import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def shown(v):
    return repr(v + 0.0) if isinstance(v, float) else repr(v)


def rows_of_spark(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())


def rows_of_sql(con, sql):
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted(tuple(shown(x[i]) for i in at) for x in result.fetchall())
