"""Every event query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidewatch.queries import event_oracle_sql, event_queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    return con


def rows_of(frame, columns):
    return sorted(str([None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in row]) for row in frame[columns].astype(object).values.tolist())


def test_all_have_sql():
    assert set(event_queries()) == set(event_oracle_sql())


@pytest.mark.parametrize("name", sorted(event_queries()))
def test_query(spark, duck, name):
    got, want = event_queries()[name](spark, DATA).toPandas(), duck.sql(event_oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)
