"""The operators that SQL can express equal their SQL."""

import pytest
from oracle import connection, differences

from glossaria.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, connection(SF), SF, QUERIES[name], ORACLE[name]) is None
