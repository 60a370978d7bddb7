"""Registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from gridtally.llm.queries import ORACLES, QUERIES
from tests.oracle_check import differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert differences(spark, con, QUERIES[name], ORACLES[name], SF) == []
