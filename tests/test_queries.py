from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from check_queries import comparable

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return connection


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query_equals_sql(spark, database, name):
    got = contract.queries()[name](spark, SF_DIR).toPandas()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = database.sql(sql).df()
    assert set(got.columns) == set(want.columns)
    assert comparable(got) == comparable(want)


def test_entry(spark):
    assert contract.entry(spark).columns == ["query_id", "chunk_id", "rank", "distance", "source", "doc_id"]


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
