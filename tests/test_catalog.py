"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessella.plans.catalog import ORACLE_SQL, QUERIES
from tessella.tables import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 4) + 0.0
    return x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, other, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    own = [tuple(_plain(r[c]) for c in names) for r in df.collect()]
    assert name in ORACLE_SQL
    result = other.sql(ORACLE_SQL[name])
    assert sorted(result.columns) == names
    at = [result.columns.index(c) for c in names]
    theirs = [tuple(_plain(r[i]) for i in at) for r in result.fetchall()]
    assert sorted(own, key=str) == sorted(theirs, key=str)
    assert own, "no rows"
