from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import ledger as lg
from tidemark.operators.baseline import build_baseline
from tidemark.operators.contract import contract_report
from tidemark.operators.evaluate import classification_metrics, metrics_long
from tidemark.operators.features import prepare
from tidemark.operators.model import score, train
from tidemark.operators.splits import assign_splits, split_sizes
from tidemark.options import DriftOptions, RegistryOptions, SplitOptions
from tidemark.sources.store import RunStore
from pyspark.sql import functions as F

REGISTRY = RegistryOptions(metric="f1", split="validation", alias="champion")
VERSIONS = "model_name string, version bigint, run_id string, metric_name string, metric_split string, candidate_metric string"
METRICS = "run_id string, split string, metric string, value double"


def _decide(spark, runs, versions, metrics, options=REGISTRY):
    runs = spark.createDataFrame(runs, "run_id string, model_name string")
    metrics = spark.createDataFrame(metrics, METRICS)
    versions = spark.createDataFrame(versions, VERSIONS)
    scored = lg.version_metrics(versions, metrics, options)
    candidates = lg.candidate_metrics(runs, metrics, options)
    return lg.promotion_status(lg.best_incumbents(scored, candidates, options), options)


def test_first_run_registers_and_an_equal_second_does_not(spark):
    metrics = [("r1", "validation", "f1", 0.8), ("r2", "validation", "f1", 0.8)]
    first = _decide(spark, [("r1", "m")], [], metrics)
    assert first.first()["status"] == "registered"
    none = spark.createDataFrame([], VERSIONS)
    new = lg.new_versions(first, none, REGISTRY)
    assert tuple(new.first())[:3] == ("m", 1, "r1")
    second = _decide(spark, [("r2", "m")], [("m", 1, "r1", "f1", "validation", "0.8")], metrics).first()
    assert (second["status"], second["incumbent_version"]) == ("not_best", 1)


def test_incumbents(spark):
    metrics = [("r1", "validation", "f1", 0.5), ("r2", "validation", "f1", 0.9), ("r3", "train", "f1", 1.0)]
    versions = [
        ("m", 1, "r1", "f1", "validation", "0.7"),  # tagged for this metric
        ("m", 2, "r2", "recall", "validation", "0.1"),  # tagged for another: its run counts
        ("m", 3, "r3", None, None, None),  # no such metric anywhere
        ("m", 4, None, None, None, None),
        ("m", 5, "r5", "f1", "validation", "0.9"),
    ]
    rows = {r["run_id"]: r for r in _decide(spark, [("r1", "m"), ("r2", "m"), ("r3", "m"), ("x", "new")], versions, metrics).collect()}
    assert (rows["r1"]["incumbent_version"], rows["r1"]["status"]) == (2, "not_best")
    assert (rows["r2"]["incumbent_version"], rows["r2"]["status"]) == (5, "not_best")
    assert rows["r3"]["status"] == "metric_unavailable"
    assert rows["x"]["incumbent_version"] is None
    low = replace(REGISTRY, greater_is_better=False)
    found = _decide(spark, [("r1", "m")], versions, metrics, low).first()
    assert (found["incumbent_metric"], found["status"]) == (0.9, "registered")
    off = _decide(spark, [("r1", "m")], versions, metrics, replace(REGISTRY, enabled=False)).first()
    assert off["status"] == "disabled"


@pytest.mark.parametrize("greater", [True, False])
@pytest.mark.parametrize("rows_per_block", [1000, 30])
def test_replayed_history(spark, greater, rows_per_block):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"model_name": rng.choice(["hot", "hot", "hot", "b"], 200), "run_no": rng.permutation(200),
                        "candidate_metric": rng.integers(0, 60, 200) / 60})
    pdf.loc[::11, "candidate_metric"] = None
    df = spark.createDataFrame(pdf).withColumn(
        "candidate_metric", F.when(~F.isnan("candidate_metric"), F.col("candidate_metric"))
    )
    options = replace(REGISTRY, greater_is_better=greater)
    got = {r["run_no"]: r for r in lg.promotion_history(df, "run_no", options, rows_per_block).collect()}
    best, version = {}, {}
    for _, r in pdf.sort_values("run_no").iterrows():
        m, value, row = r.model_name, r.candidate_metric, got[r.run_no]
        assert row["incumbent_metric"] == best.get(m)
        assert row["incumbent_version"] == version.get(m)
        if pd.isna(value):
            assert row["status"] == "metric_unavailable"
        elif m not in best or (value > best[m] if greater else value < best[m]):
            best[m], version[m] = value, version.get(m, 0) + 1
            assert (row["status"], row["version"]) == ("registered", version[m])
        else:
            assert row["status"] == "not_best"


def test_resolution(spark):
    versions = spark.createDataFrame([("m", 1, "r1"), ("m", 2, "r2")], "model_name string, version bigint, run_id string")
    aliases = spark.createDataFrame([("m", "champion", 1), ("m", "old", 1)], "model_name string, alias string, version bigint")
    moved = lg.upsert_aliases(aliases, lg.alias_rows(versions.filter("version = 2"), REGISTRY))
    assert sorted(map(tuple, moved.collect())) == [("m", "champion", 2), ("m", "old", 1)]
    assert lg.alias_rows(versions, RegistryOptions()).count() == 0
    schema = "model_name string, alias string, pinned_version bigint"
    asked = spark.createDataFrame([("m", "champion", None), ("m", None, 1)], schema)
    found = {r["model_uri"]: r["run_id"] for r in lg.resolve_models(asked, versions, moved).collect()}
    assert found == {"models:/m@champion": "r2", "models:/m/1": "r1"}
    for bad in ([("m", "champion", 1)], [("m", None, None)]):
        with pytest.raises(LookupError, match="either an alias or a version"):
            lg.resolve_models(spark.createDataFrame(bad, schema), versions, moved)
    lost = spark.createDataFrame([("m", "champion", None), ("m", None, 99)], schema)
    with pytest.raises(LookupError, match="models:/m/99"):
        lg.resolve_models(lost, versions, moved)
    kept = lg.resolve_models(lost, versions, moved, strict=False)
    assert {(r["found"], r["run_id"]) for r in kept.collect()} == {(False, None), (True, "r2")}


def test_latest_run(spark):
    runs = spark.createDataFrame([("20240101",), ("20240301",), ("20240201",)], "run_id string")
    models = spark.createDataFrame([("20240101", "a"), ("20240201", "b")], "run_id string, model_path string")
    assert tuple(lg.latest_run(runs, models).first()) == ("20240201", "b")
    assert lg.latest_run(runs, models, run_id="20240101").first()["model_path"] == "a"
    assert lg.latest_run(runs, models, model_path="a").first()["run_id"] == "20240101"


def test_training_run_end_to_end(spark, churn, churn_options, tmp_path):
    report = contract_report(churn, churn_options)
    prepared, spec = prepare(churn, churn_options, keep=("customerID",))
    split_options = SplitOptions(0.25, 0.25, 42)
    split = assign_splits(prepared, "label", "customerID", split_options).cache()
    rows = split.filter(F.col("split") == "train")
    model = train(rows, spec)
    metrics = metrics_long(classification_metrics(score(model, split)))
    baseline = build_baseline(rows, spec, DriftOptions(10, 10, 5, 5))
    store, run_id = RunStore(spark, str(tmp_path)), "20240101T000000000000Z"
    ledger = store.write_bundle(
        run_id, baseline=baseline, metrics=metrics, report=report, split_sizes=split_sizes(split),
        settings={"split": split_options, "model": {"name": "logistic_regression", "param": {"C": 1.0}}},
        generated_at="2024-01-01T00:00:00+00:00", model=model,
    ).first()
    assert (ledger["baseline_sample_size"], ledger["baseline_feature_count"]) == (12, 19)
    assert ledger["numeric_features"] == list(spec.numeric)
    sizes = {r["split"]: r["row_count"] for r in store.read("split_sizes").collect()}
    assert sizes == {"train": 12, "validation": 6, "test": 6}
    settings = {r["key"]: r["value"] for r in store.read("settings").collect()}
    assert settings["model.param.C"] == "1.0" and settings["split.seed"] == "42"
    again = score(store.load_model(run_id), split).select("customerID", "probability")
    assert sorted(again.collect()) == sorted(score(model, split).select("customerID", "probability").collect())
    keys = {r["key"] for r in lg.flatten_metrics(store.read("metrics")).collect()}
    assert {"train_f1", "test_accuracy", "validation_roc_auc"} <= keys
    bundle = store.runs_with_metadata(spark.createDataFrame([(run_id,), ("other",)], "run_id string"))
    assert {r["run_id"]: r["generated_at_utc"] for r in bundle.collect()}["other"] is None
