"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("VELLUMINE_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*cols).collect())
    r = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert cols == sorted(names)
    assert mine == sorted(repr(tuple(plain(x[i]) for i in order)) for x in r.fetchall())


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", ["chunk_documents", "chunk_with_ceiling"])
def test_other_queries_run(spark, name):
    assert entry.queries()[name](spark, DIR).count() > 0
