"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from gridtally.plans.oracles import ORACLES
from gridtally.plans.queries import QUERIES
from tests.oracle_check import differences, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = oracle(SF)
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert differences(spark, con, QUERIES[name], ORACLES[name], SF) == []


def test_entry(spark):
    assert entry.entry(spark).columns == ["analysis_hour", "total_value"]
    assert entry.entry(spark).count() > 0
