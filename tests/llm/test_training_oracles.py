"""The training-data queries that have SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from heliograph.llm.queries import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def cell(x):
    if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return ""
    return x if isinstance(x, str) else f"{float(x):.6f}"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        at = f"{FOLDER}/{f}"
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    got, want = QUERIES[name](spark, FOLDER).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    columns = sorted(got.columns)
    left, right = (sorted(tuple(map(cell, r)) for r in t[columns].itertuples(index=False)) for t in (got, want))
    assert left == right
