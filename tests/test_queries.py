import pytest
from oracle import same

from tidemark.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(registry.queries()))
def test_same_rows_as_sql(spark, name):
    assert same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF) > 0
