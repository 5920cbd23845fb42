"""The queries that SQL can express give the rows of their SQL."""

import pytest
from harness import assert_same

from offerlake.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert assert_same(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001") > 0
