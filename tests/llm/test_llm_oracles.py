"""Queries that SQL can express, on whole tables."""

import pytest
from helpers import same

from folioflow.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    same(spark, QUERIES[name], ORACLES[name], "sf0.001")


def test_eleven_queries():
    assert {n.split("_")[0] for n in QUERIES} == {"pipeline", *(f"op{i}" for i in range(1, 11))}


def test_entry_lists_them():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
