"""Every registered query runs; those with SQL equal it."""

import pytest

from sparkguard.plans import audit_queries, content_queries, file_queries, guard_queries, stream_queries

from .oracle import canonical, connect

MODULES = (audit_queries, guard_queries, content_queries, file_queries, stream_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, db, name):
    assert canonical(QUERIES[name](spark, sf).toPandas()) == canonical(db.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
