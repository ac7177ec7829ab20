"""Every named query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) & set(queries())))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, name, queries()[name], oracle_sql()[name], FOLDER) == ""


def test_entry(spark):
    assert entry(spark).count() == 1
