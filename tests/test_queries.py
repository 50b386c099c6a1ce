import pytest
from compare import connection, difference

from corvane.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(registry.QUERIES[name](spark, FOLDER), con, registry.SQL[name]) == ""


def test_every_query_without_sql_has_rows(spark):
    for name in set(registry.QUERIES) - set(registry.SQL):
        assert registry.QUERIES[name](spark, FOLDER).count() > 0
