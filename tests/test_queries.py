"""Every registered query of the engine against its SQL."""

import pytest

from brightmill.plans.queries import QUERIES, SQL


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(compare, name):
    compare(QUERIES[name], SQL[name])
