"""Every query with a check runs on the smallest tables and must equal its SQL."""

import os

import pytest
from oracle import compare, connection

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
CHECKS, QUERIES = oracle_sql(), queries()


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


def test_names():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).columns == ["drawing_id", "walls", "short_walls", "total_len", "max_width"]


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, con, name):
    result = compare(QUERIES[name](spark, SF_DIR), con, CHECKS[name])
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS) - {"plan_openings", "cross_view_match", "elevation_openings"}))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() >= 0
