"""A query's Spark rows beside the rows of its oracle SQL."""

import glob
import os

import duckdb


def rows_match(spark, run, sql, folder, tables=None):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = run(spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = con.sql(sql)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in result.fetchall()), key=str)
    assert len(got) == len(want)
    assert got == want


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v
