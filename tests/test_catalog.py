import pytest

from sievework.plans import catalog

from .oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_sql(spark, con, name):
    assert differences(catalog.QUERIES[name](spark, SF), con, catalog.ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs_and_repeats(spark, name):
    first, again = (sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect()), key=repr) for _ in range(2))
    assert first and first == again
