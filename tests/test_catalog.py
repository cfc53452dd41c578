"""Every query of the catalog against its SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog.oracle import ORACLE
from catalog.queries import QUERIES
from tools.check import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return db


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    got, want = canonical(got), canonical(con.sql(ORACLE[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(want) > 0 and got.equals(want)


def test_entry(spark):
    assert entry(spark).count() == 10
