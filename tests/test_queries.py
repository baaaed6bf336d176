"""Every query of the retrieval surface against the same in SQL, over the smallest tables."""

import duckdb
import pandas as pd
import pytest

from siltstone.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "events", "labels", "benchmark", "lineitem", "orders", "nation", "part", "customer", "supplier", "region", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_as_sql(spark, db, name):
    ours, theirs = q.queries()[name](spark, SF).toPandas(), db.execute(q.SQL[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    tidy = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(ours), tidy(theirs), check_dtype=False)
