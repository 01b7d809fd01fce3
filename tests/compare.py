"""Runs a registered query on Spark and its SQL on DuckDB and compares the rows."""

import os

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (int, float)) or type(v).__module__ == "numpy" and getattr(v, "shape", None) == () and type(v).__name__[:3] in ("int", "flo"):
        return float(f"{float(v):.9g}")
    return str(v)


def rows(pdf):
    out = [tuple(map(cell, r)) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False)]
    return sorted(out, key=repr)


def same(spark, query, sql):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = query(spark, SF).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
