"""Every registered query runs, and gives the rows of its SQL where it has one."""

import math
import os

import duckdb
import pytest

from tidewater.plans import answers, context, evidence, events, guards, integrity, prepare, reports, runs  # noqa: F401  they register queries
from tidewater.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            connection.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return f"{float(value):.9g}" if not isinstance(value, str) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    found = sql.execute(ORACLES[name])
    names, want = [c[0] for c in found.description], found.fetchall()
    assert sorted(df.columns) == sorted(names)
    got = rows_of(df.columns, df.collect())
    assert got == rows_of(names, want) and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
