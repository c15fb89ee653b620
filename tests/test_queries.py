"""Every registered query against its SQL, on the smallest tables."""
import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_returns_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    if name in entry.oracle_sql():
        assert differences(df, con, entry.oracle_sql()[name]) == []
    else:
        assert df.count() > 0
