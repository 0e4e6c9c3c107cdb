"""Every query with SQL gives the SQL's rows on the small tables; the others run."""

import glob
import os
import re

import duckdb
import pytest

from termloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, same, name):
    found = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        same(found, con.execute(catalog.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["term", "value"]
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_document_transactions_shuffle_texts_but_no_words_of_documents(spark):
    for name in ("doc_tx_commit", "doc_tx_verdicts"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(doc_id" in plan
        assert not re.search(r"hashpartitioning\(doc_id#\d+L?, (commit_seq#\d+L?, )?term", plan)


@pytest.mark.parametrize("rejected", [False, True])
def test_document_transactions_without_doc_id(spark, same, tmp_path, rejected):
    rows = [(None, "a b b"), (10, "a a c"), (1, "b c d"), (20, None)] + [(7, "a c")] * rejected
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("doc_tx_commit", "doc_tx_verdicts"):
        same(catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), c.execute(catalog.ORACLES[name]).df())
