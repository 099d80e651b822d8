import pytest
from compare import differences

from ledgerlight.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, registry.queries()[name], SQL[name], "/root/testdata/sf0.01") == ""
