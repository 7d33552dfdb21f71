"""Every registered query of the ledger and the queue against its SQL."""

import pytest

from stowage.plans import registry
from tests.oracle import assert_same, connection

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(DATA)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert_same(registry.QUERIES[name](spark, DATA), con, registry.ORACLE_SQL[name])


def test_content_hashes(spark):
    import hashlib

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = registry.QUERIES["content_hashes"](spark, DATA).collect()
    assert {r.doc_id: r.external_id for r in found} == {i: hashlib.sha3_256(t.encode()).hexdigest() for i, t in docs.items()}


def test_entry_has_all_queries(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
