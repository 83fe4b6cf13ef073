"""Every query with SQL, against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tagloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def normal(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    return f"{value:.5f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    a = sorted(tuple(normal(r[c]) for c in columns) for r in got.collect())
    b = sorted(tuple(normal(r[i]) for i in at) for r in want.fetchall())
    assert len(a) == len(b)
    off = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert len(off) <= len(a) * 0.001, off[:3]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).schema.fields
    catalog.QUERIES[name](spark, SF).limit(5).collect()
