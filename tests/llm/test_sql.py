"""The numbered queries that SQL can express, over whole small tables."""

import pytest

from pricelens.llm import registry
from tests.compare import by_sql, rows


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf, name):
    ours, theirs = registry.QUERIES[name](spark, sf).toPandas(), by_sql(registry.SQL[name], sf)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
