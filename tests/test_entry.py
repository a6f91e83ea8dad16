"""Registered queries against their SQL, where the text operators' part may be absent."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = [q for q in entry.voxel_queries.queries() if q in entry.voxel_queries.oracle_sql()]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query_matches_sql(spark, db, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = db.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
