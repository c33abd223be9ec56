from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions.distributions import psi_of_arrays
from tidemark.operators.baseline import (
    attach_baseline,
    baseline_from_json,
    baseline_to_json,
    build_baseline,
    category_counts,
    category_profile,
    cut_points,
    interval_labels,
)
from tidemark.operators.drift import drift_evaluation, drift_features
from tidemark.options import DriftOptions, FeatureSpec

SPEC = FeatureSpec(("tenure",), ("Contract",))
OPTIONS = DriftOptions(100, 50, 5, 2, 0.1, 0.2, 1)


@pytest.fixture(scope="module")
def reference(spark):
    return spark.range(100).select(
        F.col("id").cast("int").alias("tenure"),
        F.when(F.col("id") < 50, "Month-to-month").otherwise("Two year").alias("Contract"),
    )


@pytest.fixture(scope="module")
def baseline(reference):
    return build_baseline(reference, SPEC, OPTIONS).cache()


def test_shifted_window_is_drift(spark, baseline):
    observed = spark.range(100).select(F.lit(240).alias("tenure"), F.lit("Two year").alias("Contract"))
    tenure, contract = drift_features(observed, baseline, OPTIONS).collect()
    assert baseline.filter("feature_pos = 0").first()["cut_points"] == pytest.approx([19.8, 39.6, 59.4, 79.2])
    assert (tenure["feature_name"], tenure["psi"]) == ("tenure", pytest.approx(11.052360, abs=1e-6))
    assert (contract["feature_name"], contract["psi"]) == ("Contract", pytest.approx(6.907742, abs=1e-6))
    row = drift_evaluation(observed, baseline, OPTIONS).first()
    assert (row["status"], row["drifted_feature_count"]) == ("drift_detected", 2)
    assert [r["feature_name"] for r in row["feature_results"]] == ["tenure", "Contract"]


def test_same_table_has_no_drift(reference, baseline):
    rows = drift_features(reference, baseline, OPTIONS).collect()
    assert [r["feature_name"] for r in rows] == ["tenure", "Contract"]
    for r in rows:
        assert r["psi"] == 0 and r["status"] == "stable"
        assert sum(r["observed_distribution"]) == pytest.approx(1)
        assert len(r["bucket_labels"]) == len(r["observed_distribution"])


def test_gate(reference, baseline):
    few = reference.limit(49)
    assert drift_features(few, baseline, OPTIONS).count() == 0
    row = drift_evaluation(few, baseline, OPTIONS).first()
    assert (row["status"], row["max_feature_psi"], row["feature_results"]) == ("insufficient_data", 0.0, [])
    assert drift_evaluation(reference.limit(0), baseline, OPTIONS).first()["observed_sample_size"] == 0


def test_absent_and_invalid_values_count_as_missing(spark, reference, baseline):
    observed = reference.select(F.concat(F.col("tenure").cast("string"), F.lit("x")).alias("tenure"))
    for r in drift_features(observed, baseline, OPTIONS).collect():
        assert r["observed_distribution"][0] == 1.0 and r["status"] == "drift"


def test_text_numbers_and_nan(spark, baseline):
    observed = spark.range(100).select(
        F.format_string(" %d ", "id").alias("tenure"), F.lit(float("nan")).alias("Contract")
    )
    rows = {r["feature_name"]: r for r in drift_features(observed, baseline, OPTIONS).collect()}
    assert rows["tenure"]["psi"] == 0


@pytest.mark.parametrize("values", [[0] * 99 + [1], [5] * 10, [1, 2], [1, 1, 2, 3]])
def test_degenerate_cut_points(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    bins = min(10, len(set(values)))
    want = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)))[1:-1] if bins > 1 else []
    assert cut_points(df, ["x"], 10)["x"] == pytest.approx(list(want))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from([-3.5, 0.0, 0.1, 1.0, 2.0, 7.25, 100.0]), min_size=2, max_size=40),
       st.integers(1, 12))
def test_cut_points_follow_the_definition(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    distinct = len(set(values))
    edges = np.unique(np.quantile(values, np.arange(min(bins, distinct) + 1) / min(bins, distinct)))
    want = edges[1:-1] if distinct > 1 else []
    assert cut_points(df, ["x"], bins)["x"] == pytest.approx(list(want))


def test_buckets_are_closed_on_the_right(spark):
    reference = spark.range(1, 5).select(F.col("id").cast("double").alias("x"))
    baseline = build_baseline(reference, FeatureSpec(("x",)), DriftOptions(10, 1, 2, 1))
    row = baseline.first()
    assert row["cut_points"] == [2.5]
    observed = spark.createDataFrame([(2.5,), (2.6,), (float("-inf"),), (float("inf"),), (None,)], "x double")
    result = drift_features(observed, baseline, DriftOptions(10, 1, 2, 1)).first()
    assert result["observed_distribution"] == [0.2, 0.4, 0.4]


def test_all_missing_feature(spark):
    df = spark.createDataFrame([(None, None)] * 4, "x double, c string")
    numeric, text = build_baseline(df, FeatureSpec(("x",), ("c",)), OPTIONS).orderBy("feature_pos").collect()
    assert numeric["bucket_labels"] == ["__missing__", "all_values"]
    assert numeric["expected_distribution"] == [1.0, 0.0] and numeric["metadata"]["mean"] is None
    assert text["expected_distribution"] == [1.0, 0.0] and text["tracked_categories"] == []


def test_empty_table_is_an_error(spark):
    df = spark.createDataFrame([], "x double, c string")
    for spec in (FeatureSpec(("x",)), FeatureSpec((), ("c",))):
        with pytest.raises(ValueError, match="empty"):
            build_baseline(df, spec, OPTIONS)


def test_top_categories(spark):
    values = ["b"] * 3 + ["a"] * 3 + ["c"] * 5 + ["__other__"] * 9 + [None, " "]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    row = category_profile(category_counts(df, ["c"]), 2).first()
    assert row["tracked_categories"] == ["c", "a"]
    assert (row["sample_size"], row["missing"], row["unique_value_count"]) == (22, 2, 5)
    baseline = build_baseline(df, FeatureSpec((), ("c",)), OPTIONS).first()
    assert baseline["expected_distribution"] == pytest.approx([2 / 22, 5 / 22, 3 / 22, 12 / 22])


def test_many_values_meet_as_candidates_only(spark):
    df = spark.range(5000).select(F.concat(F.lit("v"), F.least("id", F.lit(4000))).alias("c"))
    row = category_profile(category_counts(df, ["c"]), 3).first()
    assert row["tracked_categories"] == ["v4000", "v0", "v1"] and row["unique_value_count"] == 4001


def test_json_round_trip(spark, baseline):
    back = baseline_from_json(baseline_to_json(baseline)).orderBy("feature_pos").collect()
    assert back == baseline.orderBy("feature_pos").collect()
    models = spark.createDataFrame([("m1",), ("m2",)], "monitor_key string")
    attached = attach_baseline(models, baseline)
    assert attached.count() == 4 and attached.columns[0] == "monitor_key"


def test_psi_needs_equal_lengths(spark):
    df = spark.createDataFrame([([0.5, 0.5], [0.2, 0.8]), ], "e array<double>, o array<double>")
    want = (0.2 - 0.5) * np.log(0.2 / 0.5) + (0.8 - 0.5) * np.log(0.8 / 0.5)
    assert df.select(psi_of_arrays(F.col("e"), F.col("o"))).first()[0] == pytest.approx(want)
    bad = spark.createDataFrame([([0.5, 0.5], [1.0])], "e array<double>, o array<double>")
    with pytest.raises(PySparkException, match="length"):
        bad.select(psi_of_arrays(F.col("e"), F.col("o"))).collect()


def test_interval_labels():
    assert interval_labels([]) == ["__missing__", "all_values"]
    assert interval_labels([1.23456, 2.0]) == ["__missing__", "(-inf, 1.235]", "(1.235, 2.0]", "(2.0, inf]"]
    assert interval_labels([1.00001, 1.00002])[1] == "(-inf, 1.00001]"
