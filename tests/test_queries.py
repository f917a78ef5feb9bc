"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, connect

from __spark_entry__ import LLM_QUERIES, entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()
# The training-data queries have tests of their own.
NAMES = [n for n in queries() if n not in LLM_QUERIES]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert compare(spark, con, name, queries()[name], SQL.get(name), SF) == ""


def test_every_query_has_sql_or_is_listed():
    assert set(NAMES) - set(SQL) == {"E14_train_dataset_model", "J9_fuzzy_match"}


def test_entry(spark):
    assert entry(spark).count() == 90
