"""Every query of the library against its SQL, over whole small tables."""

import pytest

from pricelens.plans import queries as plans
from tests.compare import by_sql, rows


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, sf, name):
    ours, theirs = plans.QUERIES[name](spark, sf).toPandas(), by_sql(plans.SQL[name], sf)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", ["repaired_documents", "listing_attributes", "page_products", "fuzz_token_set", "listing_queries", "match_rank", "structured_verdicts", "discover_cells", "watchlist_fill"])
def test_query_covers_its_table(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
