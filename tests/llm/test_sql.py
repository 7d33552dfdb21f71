"""Corpus queries that SQL can express, against it, over whole tables."""

import pytest

from stowage.llm import queries
from tests.oracle import assert_same, connection

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, DATA), connection(DATA), queries.ORACLE_SQL[name])
