import pytest

from folioflow.session import get_spark


@pytest.fixture(scope="session")
def spark():
    return get_spark("tests", 4, **{"spark.sql.shuffle.partitions": "4"})
