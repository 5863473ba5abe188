"""The registered queries against their SQL, and the module lists."""

import pytest

from brightmill.llm.queries import QUERIES, SQL


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(compare, name):
    compare(QUERIES[name], SQL[name])
