"""Every query of the library that SQL can express gives the rows of its SQL."""

import pytest
from harness import assert_same

import __spark_entry__
from offerlake.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert assert_same(spark, QUERIES[name], ORACLES[name], SF) >= 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.count() > 0
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())
