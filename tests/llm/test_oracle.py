"""Queries that SQL can express, against that SQL."""

import duckdb
import pytest

from __spark_entry__ import queries
from docloom.llm.oracle import ORACLE
from docloom.llm.queries import QUERIES
from tools.check import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = canonical(QUERIES[name](spark, FOLDER).toPandas())
    want = canonical(con.sql(ORACLE[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(want) > 0 and got.equals(want)


def test_all_queries_are_registered():
    assert set(QUERIES) <= set(queries())
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in QUERIES) == 1
