"""Every registered query against its SQL, on the smallest tables."""

import pytest

from originlens.plans import check, registry

registry.load_all()


@pytest.fixture(scope="module")
def duck(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, sf, name):
    assert check.compare(registry.QUERIES[name](spark, sf), duck, registry.ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
