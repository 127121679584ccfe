"""The registered training-data queries: those with SQL against it, the others for their contract."""

from __future__ import annotations

import duckdb
import pytest
from check_oracle import TABLES, rows_of

from __spark_entry__ import oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", ["op4_gzip_normaliser", "op7_lsh_forest", "op8_cap_filters", "op11_letter_count_trees", "op12_count_automata"])
def test_query_matches_sql(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(oracle_sql()[name])
    assert ours == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries() if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries()


def test_pipeline_packs_whole_documents(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF_DIR).toPandas()
    assert len(corpus_pipeline.STAGES) == 5 and len(out)
    assert out.groupby("bin_id").words.sum().max() <= corpus_pipeline.CAPACITY
    assert not out.duplicated(["bin_id", "doc_id"]).any()
    assert not out.duplicated(["bin_id", "place"]).any()
