"""Every query that has SQL against it, the others for their rows."""

import pytest

from originlens.llm import queries
from originlens.plans import check


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf, name):
    assert check.compare(queries.QUERIES[name](spark, sf), check.connect(sf), queries.ORACLES[name]) == []


def test_registered():
    import __spark_entry__ as e

    names = {n.split("_")[0] for n in e.queries()}
    assert {f"op{i}" for i in range(1, 11)} | {"pipeline"} <= names
