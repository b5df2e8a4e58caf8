"""Every registered query against its SQL, on the smallest tables."""

import oracle
import pytest
from conftest import TESTDATA

from tallyframe.queries import REGISTRY

pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(str(TESTDATA))


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_query_equals_sql(spark, con, name):
    assert oracle.differences(spark, con, str(TESTDATA), name) == []


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
