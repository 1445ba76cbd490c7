import pytest

from folioflow.plans import catalog
from tests.oracle import assert_same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, name):
    assert_same(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], SF)
