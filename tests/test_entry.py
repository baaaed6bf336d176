"""The driver's contract: every query has a name, SQL exists for queries only, and the flagship runs."""

import __spark_entry__ as entry


def test_sql_is_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    found = entry.entry(spark)
    assert found.columns == ["query_id", "id", "dense_rank", "sparse_rank", "score", "rank"] and found.count() > 0
