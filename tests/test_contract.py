"""Every registered query against its SQL, on the smallest tables where they are there."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from larkspur.plans import catalogue
from larkspur.sources.readers import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

QUERIES, SQL = catalogue.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in df.collect()) if name in SQL else df.collect()
    if name not in SQL:
        assert rows
        return
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert str(rows) == str(sorted([plain(r[names.index(c)]) for c in columns] for r in cur.fetchall()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())
