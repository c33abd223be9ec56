from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions.columns import normalize_category, sanitize_key, to_number
from tidemark.operators.contract import (
    ContractError,
    check_records,
    churn_record_rules,
    contract_report,
    rejected_records,
    request_sizes,
    valid_records,
)
from tidemark.operators.features import align_schema, encode_target, prepare, resolve_features
from tidemark.options import DatasetOptions
from dataclasses import replace


def test_lenient_numbers(spark):
    texts = {
        " 12 ": 12.0, "1e3": 1000.0, "inf": float("inf"), "-Infinity": float("-inf"), "+.5": 0.5,
        "1.": 1.0, "12d": None, "0x10": None, "1_000": None, "1,000": None, "": None, ".": None,
        " 7 ": 7.0, "1f": None, "nan": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.n for r in df.select("t", to_number("t").alias("n")).collect()} == texts


def test_categories_strip_all_white_space(spark):
    df = spark.createDataFrame([(" a\t",), ("\n ",), (None,), ("　b",)], "t string")
    found = [r[0] for r in df.select(normalize_category("t")).collect()]
    assert found == ["a", "__missing__", "__missing__", "b"]


def test_key_falls_back(spark):
    df = spark.createDataFrame([("a b/c",), ("._x_.",), ("//",)], "t string")
    assert [r[0] for r in df.select(sanitize_key("t")).collect()] == ["a_b_c", "x", "drift_monitor"]


def test_one_class_is_refused(churn, churn_options):
    with pytest.raises(ContractError, match="at least two classes"):
        contract_report(churn.withColumn("Churn", F.lit("Yes")), churn_options)


def test_missing_feature_names_its_section(churn, churn_options):
    with pytest.raises(ContractError, match="data.numeric_features"):
        contract_report(
            churn.drop("tenure"), replace(churn_options, required_columns=("customerID",))
        )


def test_null_target_and_empty_table(churn, churn_options):
    gap = churn.withColumn("Churn", F.when(F.col("tenure") > 20, F.col("Churn")))
    with pytest.raises(ContractError, match="missing"):
        contract_report(gap, churn_options)
    with pytest.raises(ContractError, match="no rows"):
        contract_report(churn.limit(0), churn_options)


def test_record_rules(spark, churn_rows):
    good = {k: str(v) for k, v in churn_rows[1].items() if k not in ("customerID", "Churn")}
    cases = {
        "good": {}, "blank total": {"TotalCharges": " "}, "no total": {"TotalCharges": None},
        "text total": {"TotalCharges": "not-a-number"}, "negative": {"MonthlyCharges": "-1"},
        "senior": {"SeniorCitizen": "2"}, "tenure": {"tenure": "1.5"}, "empty": {"gender": "  "},
        "two": {"gender": None, "tenure": "-3"},
    }
    rows = [Row(case=name, **(good | change)) for name, change in cases.items()]
    checked = check_records(spark.createDataFrame(rows), churn_record_rules())
    found = {r["case"]: r["errors"] for r in checked.collect()}
    assert found == {
        "good": [], "blank total": [], "no total": [], "text total": ["TotalCharges:number"],
        "negative": ["MonthlyCharges:number"], "senior": ["SeniorCitizen:choice"],
        "tenure": ["tenure:integer"], "empty": ["gender:text"],
        "two": ["gender:text", "tenure:integer"],
    }
    assert valid_records(checked).count() == 3
    assert rejected_records(checked).count() == 6


def test_request_size_bounds(spark):
    df = spark.range(1005).select(F.when(F.col("id") < 1001, "big").otherwise("small").alias("q"))
    found = {r["q"]: (r["record_count"], r["accepted"]) for r in request_sizes(df, "q").collect()}
    assert found == {"big": (1001, False), "small": (4, True)}


def test_prepare_keeps_extra_column_out_of_features(churn, churn_options):
    prepared, spec = prepare(churn.withColumn("LeakageScore", F.lit(999)), churn_options)
    assert "customerID" not in prepared.columns
    assert "LeakageScore" in prepared.columns and "LeakageScore" not in spec.all
    assert spec.numeric == ("tenure", "MonthlyCharges", "TotalCharges")
    assert {r["label"] for r in prepared.select("label").distinct().collect()} == {0, 1}


def test_feature_groups(spark):
    df = spark.createDataFrame([(1, 2.0, "x", True)], "a int, b double, c string, d boolean")
    assert resolve_features(df, DatasetOptions(target="y")).all == ("a", "b", "d", "c")
    listed = DatasetOptions(target="y", numeric_features=("b",))
    assert resolve_features(df, listed).all == ("b",)
    rest = replace(listed, infer_remaining_features=True)
    assert resolve_features(df, rest).numeric == ("b", "a", "d")
    with pytest.raises(ValueError, match="numeric and as categorical"):
        resolve_features(df, DatasetOptions(target="y", numeric_features=("b",), categorical_features=("b",)))


def test_target_encoding(spark):
    def labels(values, kind, positive="Yes"):
        df = spark.createDataFrame([(v,) for v in values], f"y {kind}")
        return [r["label"] for r in encode_target(df, "y", positive).collect()]

    assert labels([True, False], "boolean") == [1, 0]
    assert labels([0.5, 1.0], "double") == [0, 1]
    assert labels([" Yes", "No "], "string") == [1, 0]
    assert labels([3, 7], "int", "7") == [0, 1]
    for bad in (["Yes", None], ["Yes", "No", "Maybe"], ["A", "B"]):
        with pytest.raises(ValueError):
            labels(bad, "string")


def test_alignment(spark):
    df = spark.createDataFrame([("1.5", 2)], "b string, extra int")
    row = align_schema(df, {"a": "int", "b": "double"}, coerce=["b", "a"]).first()
    assert row.asDict() == {"a": None, "b": 1.5}
