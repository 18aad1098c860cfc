"""Queries with SQL twins on the small tables; the others are held against brute force in test_operators and test_pipeline."""

import pytest

from tests.oracle import connect, difference
from tidemark.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name]) is None
