"""Every registered query that has an SQL twin gives the same rows."""

import pytest

from isopleth.plans import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, con, name):
    assert compare(spark, con, SF, registry.queries()[name], SQL[name]) > 0
