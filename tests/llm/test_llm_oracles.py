import pytest
from compare import differences

from ledgerlight.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, queries.queries()[name], oracles.oracle_sql()[name], "/root/testdata/sf0.01") == ""
