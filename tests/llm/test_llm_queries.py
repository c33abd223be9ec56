"""The registered queries over the smallest tables, and the pipeline against its operators."""

from __future__ import annotations


import duckdb
import pytest

import corpus_pipeline
from helpers import SF, awkward_documents, document_table
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    mine = sorted(tuple(r[c] for c in sorted(got.columns)) for r in got.collect())
    assert mine == sorted(tuple(r[i] for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    table = {"op4": "embeddings", "op5": "pages"}.get(name.split("_")[0], "documents")
    assert rows.count() >= (spark.read.parquet(f"{SF}/{table}.parquet").count() if name != "pipeline" else 1)


def test_stages_keep_columns_and_documents(spark):
    rows = [*awkward_documents(), (400, "call +1 (437) 555-0689 now")]
    docs = document_table(spark, rows)
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = docs.cache()
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(seen["language"]) == {i for i, t in rows if t and any(c.isalpha() for c in t)}
    assert set(seen["line_chunks"]) == set(seen["language"])
    assert 95 not in seen["near_copies"] and 5 in seen["near_copies"]
    assert seen["personal_data"][400] == "call [PHONE] now"
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(seen["personal_data"])


def test_stages_on_an_empty_table(spark):
    docs = document_table(spark, awkward_documents()).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        if "text" not in docs.columns:
            break
