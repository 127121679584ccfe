"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from check_oracle import TABLES, rows_of

from __spark_entry__ import entry, oracle_sql, queries
from ledgerline.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"
# Model-based results have no SQL counterpart; their tests are in test_models and test_forecast.
MODELS = {
    "forecast_arima",
    "segments",
    "segment_profile",
    "demand_importance",
    "demand_metrics",
    "demand_importance_poisson",
    "demand_scores",
}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


def test_every_query_has_sql_or_is_a_model():
    assert set(QUERIES) - set(oracle_sql()) == MODELS
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODELS))
def test_query_matches_sql(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(oracle_sql()[name])
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]


@pytest.mark.parametrize("name", ["forecast_arima", "segment_profile", "demand_importance_poisson", "demand_scores"])
def test_model_queries_give_rows(spark, name):
    assert not queries()[name](spark, SF_DIR).isEmpty()
