"""Registered queries against their SQL, and the stages of the pipeline against the operators."""

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from agroseries.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_the_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries()[name](spark, SF)
    cursor = duck.execute(oracle_sql()[name])
    columns = sorted(d[0] for d in cursor.description)
    assert sorted(df.columns) == columns
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=repr) == want


def test_names():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
    assert "pipeline" in queries() and set(QUERIES) <= set(queries())


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SF)
        assert made.columns == docs.columns, name
        docs = corpus_pipeline.saved(made, name)
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(rows) <= set(left)
        if name != "personal_data":
            assert all(rows[i] == left[i] for i in rows), name
        left = rows
    assert not any("@mail" in (t or "") for t in left.values()) and len(left) > 100
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p["doc_id"] for p in pieces} == set(left)


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
