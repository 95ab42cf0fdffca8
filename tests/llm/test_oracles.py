"""The subpackage's queries against their SQL."""

import os

import duckdb
import pytest

from tests.test_queries import rows_of
from tidewater.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    sql = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            sql.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    found = sql.execute(ORACLES[name])
    names, want = [c[0] for c in found.description], found.fetchall()
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, want) and want
