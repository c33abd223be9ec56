from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators.contract import ContractError
from tidemark.options import DatasetOptions, FeatureSpec, SplitOptions
from tidemark.sources.delimited import _headers, inferred_types, load_dataset, read_dataset, read_text_table
from tidemark.sources.store import RunStore, files_key, safe_run_id, settings_key


def _write(tmp_path, text):
    path = tmp_path / "data.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_churn_file_has_24_rows_and_21_columns(spark, churn_csv, churn_options):
    df, report = load_dataset(spark, churn_csv, churn_options)
    row = report.first()
    assert (row["row_count"], row["column_count"]) == (24, 21)
    assert row["class_count"] == 2
    assert df.columns[0] == "customerID"
    assert df.filter("TotalCharges is null").count() == 1
    assert dict(df.dtypes)["TotalCharges"] == "double"
    assert dict(df.dtypes)["tenure"] == "bigint"


def test_renames_differ_by_case_only(spark, tmp_path):
    path = _write(tmp_path, "﻿CustomerID, Gender ,Churn Label\n1,Male,Yes\n")
    options = DatasetOptions(
        target="Churn", renames={"CustomerID": "customerID", "Gender": "gender", "Churn Label": "Churn"}
    )
    assert read_dataset(spark, path, options).columns == ["customerID", "gender", "Churn"]


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_dataset(spark, str(tmp_path / "none.csv"), DatasetOptions(target="y"))


def test_missing_target_is_named(spark, tmp_path):
    path = _write(tmp_path, "customerID,MonthlyCharges\n1,2.5\n")
    with pytest.raises(ContractError, match="Target column 'Churn'"):
        load_dataset(spark, path, DatasetOptions(target="Churn"))


def test_repeated_names(spark, tmp_path):
    with pytest.raises(ContractError, match="repeat"):
        read_text_table(spark, _write(tmp_path, "a, a\n1,2\n"), DatasetOptions(target="a"))


def test_tokens_and_types(spark, tmp_path):
    path = _write(
        tmp_path,
        'i,f,b,s,e,q\n1,1e3,True,x,,"a ""b"""\n2,inf,false,NULL,n/a,"c,d"\n 3 ,NaN,TRUE,None,nan,-\n',
    )
    df = read_dataset(spark, path, DatasetOptions(target="s", na_values=("-",)))
    assert dict(df.dtypes) == {
        "i": "bigint", "f": "double", "b": "boolean", "s": "string", "e": "double", "q": "string"
    }
    rows = [tuple(r) for r in df.collect()]
    assert rows[0] == (1, 1000.0, True, "x", None, 'a "b"')
    assert rows[1] == (2, float("inf"), False, None, None, "c,d")
    assert rows[2] == (3, None, True, None, None, None)


def test_headers_are_read_alone(spark, tmp_path):
    import gzip

    folder = tmp_path / "many files"
    folder.mkdir()
    (folder / "a%20.csv").write_text("\n  \n\ufeffa,\"b, c\"\n1,x\n", encoding="utf-8")
    with gzip.open(folder / "b.csv.gz", "wt", encoding="utf-8") as f:
        f.write("\"b, c\",a\ny,2\n,3\n")
    (folder / "c.csv").write_text("")
    (folder / "_hidden.csv").write_text("other\n1\n")
    df = read_dataset(spark, str(folder), DatasetOptions(target="a"), multiline=False)
    assert df.dtypes == [("a", "bigint"), ("b, c", "string")]
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x"), (2, "y"), (3, None)]


def test_too_many_fields_are_seen_with_the_types(spark, tmp_path):
    path = _write(tmp_path, "a,b\n1,2\n3,4,5\n")
    for read in (read_dataset, read_text_table):
        with pytest.raises(ContractError, match="more than 2 fields"):
            read(spark, path, DatasetOptions(target="a"))


def test_headers_and_checks_take_one_scan(spark, tmp_path):
    path = _write(tmp_path, "a,b\n1,2\n3,4\n")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    try:
        spark.sparkContext.setJobGroup("headers", "")
        assert len(_headers(spark, path)) == 1 and not jobs("headers")
        spark.sparkContext.setJobGroup("types", "")
        inferred_types(spark.read.option("header", True).csv(path)).collect()
        spark.sparkContext.setJobGroup("dataset", "")
        assert read_dataset(spark, path, DatasetOptions(target="a")).dtypes == [("a", "bigint"), ("b", "bigint")]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # beside the test of the types there is no job; the first reader has one that looks for its header
    assert len(jobs("dataset")) <= len(jobs("types"))


def test_stage_is_built_once(spark, tmp_path):
    store, calls = RunStore(spark, str(tmp_path)), []

    def build():
        calls.append(1)
        return spark.range(5)

    assert store.stage("ingestion", "r1", build).count() == 5
    assert store.stage("ingestion", "r1", build).count() == 5
    assert len(calls) == 1
    assert store.read_run("stages/ingestion", "r2") is None
    with pytest.raises(ValueError):
        store.stage("unknown", "r1", build)


def test_run_id_is_made_safe(spark):
    assert safe_run_id(spark, "2026-03-30T00:00:00+00:00") == "2026-03-30T00_00_00_00_00"
    assert safe_run_id(spark, "..//..") == "run"


def test_stage_follows_its_inputs(spark, tmp_path):
    store, calls, data = RunStore(spark, str(tmp_path / "store")), [], str(tmp_path / "data")

    def run(seed=1):
        def build():
            calls.append(seed)
            return spark.read.parquet(data).withColumn("seed", F.lit(seed))

        raw = store.stage("ingestion", "r1", lambda: spark.read.parquet(data), [files_key(spark, data)])
        key = store.stage_key("ingestion", "r1")
        return raw.count(), store.stage("preprocessing", "r1", build, [key], SplitOptions(seed=seed)).first()["seed"]

    spark.range(5).write.parquet(data)
    assert run() == (5, 1) and run() == (5, 1) and calls == [1]
    assert run(2) == (5, 2) and calls == [1, 2]
    spark.range(3).write.mode("append").parquet(data)
    assert run(2) == (8, 2) and calls == [1, 2, 2] and run(2) == (8, 2) and len(calls) == 3
    # killed while it was building: the old output has lost its key, so it is not taken
    with pytest.raises(ZeroDivisionError):
        store.stage("preprocessing", "r1", lambda: 1 / 0, ["other"])
    assert store.stage_key("preprocessing", "r1") is None
    assert run(2) == (8, 2) and len(calls) == 4
    assert settings_key({"a": 1, "b": 2}) == settings_key({"b": 2, "a": 1}) != settings_key({"a": 1, "b": 3})


def test_summary_with_splits_and_features(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    df = spark.range(7).select("id", F.when(F.col("id") < 2, "test").otherwise("train").alias("split"))
    row = store.summarize_stage("preprocessing", "r", df, "split", FeatureSpec(("id",))).first()
    assert (row["row_count"], row["split_sizes"]) == (7, {"test": 2, "train": 5})
    assert (row["numeric_features"], row["categorical_features"]) == (["id"], [])
    plain = store.summarize_stage("ingestion", "r", df.limit(0)).first()
    assert (plain["row_count"], plain["split_sizes"], plain["numeric_features"]) == (0, None, None)
    empty = store.summarize_stage("evaluation", "r", df.limit(0), "split").first()
    assert (empty["row_count"], empty["split_sizes"]) == (0, {})
