"""Every registered query equals its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from check import compare, connect

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, connection):
    problems, _ = compare(QUERIES[name], ORACLES[name], spark, connection, SF_DIR)
    assert not problems, problems[:5]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(name, spark):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 150 and df.columns[:2] == ["c_custkey", "is_churn"]
