"""Every core query against its SQL on the smallest tables."""

import pytest

from corvidex.plans import core, search

QUERIES, ORACLES = {**search.QUERIES, **core.QUERIES}, {**search.ORACLES, **core.ORACLES}


def test_every_core_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, same):
    same(QUERIES[name], ORACLES[name])


def test_entry_points():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
