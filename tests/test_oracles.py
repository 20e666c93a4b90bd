"""Every query with SQL gives the rows of its SQL on the smallest tables; the others run."""

import pytest

from tessera import slate
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(slate.QUERIES))
def test_query(spark, con, name):
    if name in slate.ORACLES:
        assert compare(spark, con, name, slate.QUERIES[name], slate.ORACLES[name], SF) == ""
    else:
        assert slate.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
