from __future__ import annotations

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from helpers import SF, awkward_documents, document_table
from tidemark.llm import language as la


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = la.fit_language_model(docs.filter(~la.held_out("doc_id")))
    assert sum(len(f) for f in model.families) == docs.select("lang").distinct().count()
    found = la.predict_language(docs.filter(la.held_out("doc_id")), model, "doc_id", "text", {"lang": F.col("lang")})
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    assert found.filter("score < 0 OR score > 1").count() == 0


def test_hold_out_rule(spark):
    import zlib

    rows = spark.range(200).select("id", la.held_out("id").alias("out")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_awkward_rows(spark):
    docs = document_table(spark, awkward_documents())
    model = la.fit_language_model(docs)
    assert model.families == (("en",),)
    rows = la.predict_language(docs, model, "doc_id", "text").collect()
    assert len(rows) == docs.count()
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in rows if r["id"] is not None}
    assert got[100] == got[101] == got[104] == got[106] == ("und", 0.0)
    assert got[102] == ("en", 1.0)
    kept = la.keep_identified(docs, model, "text", 0.2)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id IN (100, 101, 104, 106)").count() == 0
    assert kept.filter("doc_id = 5").count() == 3


def test_no_labels_and_empty(spark):
    docs = document_table(spark, awkward_documents())
    none = la.fit_language_model(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none.families == ()
    assert {r["lang_pred"] for r in la.predict_language(docs, none, "doc_id", "text").collect()} == {"und"}
    assert la.predict_language(docs.limit(0), none, "doc_id", "text").count() == 0


def test_sample_is_bounded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang")
    sizes = la.sample_rows(docs, 10).groupBy("lang").count().collect()
    assert all(r["count"] <= 10 for r in sizes)


def test_a_machine_is_trained_beside_one_copy_of_its_rows():
    rng = np.random.default_rng(2)
    x = rng.random((400, la.DIMENSIONS + 1)).astype(np.float32)
    y = np.where(x[:, 0] > 0.5, 1.0, -1.0)
    tracemalloc.start()
    try:
        line = la.train_line(x, y, rounds=3)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < x.nbytes / 4
    assert line.dtype == np.float32 and line.any()
