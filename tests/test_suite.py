"""Every registered query over the smallest test tables, against its SQL."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import differences, open_tables

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    return open_tables(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, tables, name):
    df = queries()[name](spark, FOLDER)
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        # At this size a result may rightly be empty, such as a backlog without missing vectors.
        _, notes = differences(df, tables, sql)
        assert not notes


def test_entry(spark):
    assert {"id", "score", "show"} <= set(entry(spark).columns)
