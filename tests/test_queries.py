"""Every registered query against its SQL, and the rest for rows."""

import pytest
from compare import SF, duck, same

from heatgrid import registry


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, name):
    same(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
