"""Every core query against its SQL twin; those without one give rows of a stable schema."""

import oracle
import pytest

from corpusmill.plans import REGISTRY


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_sql_twin(spark, con, data, name):
    assert oracle.compare(spark, con, REGISTRY.queries[name], REGISTRY.sql[name], data) == ""


def query_rows_once_more(spark, data, name):
    return REGISTRY.queries[name](spark, data).count()


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.sql)))
def test_without_sql(spark, data, name):
    df = REGISTRY.queries[name](spark, data)
    rows = df.count()
    assert df.columns and rows > 0 and rows == query_rows_once_more(spark, data, name)


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream_equals_batch(spark, data):
    batch = {(str(r.thread), r.n, r.batch) for r in REGISTRY.queries["batch_complete"](spark, data).collect()}
    live = {(r.thread, r.n, r.batch) for r in REGISTRY.queries["stream_batches"](spark, data).collect()}
    assert batch == live
