import pytest
from conftest import SF
from oracle import duck, same

from flowgrid.plans import registry


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, connection, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], connection)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_oracle_has_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 66
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
