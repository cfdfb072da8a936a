"""Every registered query with SQL gives DuckDB's rows."""

import pytest
from helpers import same

from folioflow.plans import catalog_queries, document_queries, layout_queries, text_queries, tooling_queries

QUERIES = text_queries.QUERIES | catalog_queries.QUERIES | layout_queries.QUERIES | document_queries.QUERIES | tooling_queries.QUERIES
ORACLES = text_queries.ORACLES | catalog_queries.ORACLES | layout_queries.ORACLES | document_queries.ORACLES | tooling_queries.ORACLES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
