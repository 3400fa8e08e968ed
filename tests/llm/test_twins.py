"""Queries against their DuckDB twins, and the shape of every registered query."""

import pytest

from buylens.llm import oracle, queries
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_twin(llm, name):
    assert compare(queries.queries()[name](llm, SF), connect(SF), oracle.oracle_sql()[name]) is None


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
