from __future__ import annotations

from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.baseline import attach_baseline, build_baseline
from tidemark.operators.monitor import (
    AT,
    BATCH,
    KEY,
    SEQ,
    decide,
    drift_events,
    evaluate_history,
    monitor_states,
    retraining_decisions,
    retraining_requests,
    rolling_window,
)
from tidemark.options import DriftOptions, FeatureSpec, RetrainingOptions
from tidemark.plans.ordered import positions
from tidemark.session import new_folder
from tidemark.streaming.monitor import MonitorStream, read_monitor_table

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SPEC = FeatureSpec(("x", "z"), ("c",))
OPTIONS = DriftOptions(60, 25, 4, 2, 0.1, 0.25, 1)
RETRAINING = RetrainingOptions(cooldown_minutes=45)


@pytest.fixture(scope="module")
def history():
    """Batches of 1 to 90 rows; one monitor has most of the rows."""
    rng = np.random.default_rng(11)
    rows, seq = [], 0
    for batch in range(60):
        key = "hot" if rng.random() < 0.7 else rng.choice(["m1", "m2"])
        shift = 3.0 if 20 <= batch < 40 else 0.0
        for _ in range(int(rng.choice([1, 3, 10, 30, 90]))):
            rows.append(
                (key, batch, seq, START + timedelta(minutes=10 * batch, seconds=int(seq % 60)),
                 float(rng.normal() + shift), None if rng.random() < 0.1 else float(rng.integers(0, 3)),
                 str(rng.choice(["a", "b", "c", " "])))
            )
            seq += 1
    return pd.DataFrame(rows, columns=[KEY, BATCH, SEQ, AT, "x", "z", "c"])


SCHEMA = f"{KEY} string, {BATCH} bigint, {SEQ} bigint, {AT} timestamp, x double, z double, c string"


@pytest.fixture(scope="module")
def rows(spark, history):
    records = [
        (k, int(b), int(q), at.to_pydatetime(), float(x), None if pd.isna(z) else float(z), c)
        for k, b, q, at, x, z, c in history.itertuples(index=False, name=None)
    ]
    return spark.createDataFrame(records, SCHEMA).cache()


@pytest.fixture(scope="module")
def baselines(spark, rows):
    shared = build_baseline(rows.filter(F.col(BATCH) < 20), SPEC, OPTIONS)
    models = spark.createDataFrame([("hot",), ("m1",), ("m2",)], f"{KEY} string")
    return attach_baseline(models, shared).cache()


def _psi(e, o):
    e, o = np.maximum(e, 1e-6), np.maximum(o, 1e-6)
    return float(((o - e) * np.log(o / e)).sum())


def _expected(history, baselines):
    """Definition, row by row: keep the last rows, rebuild every histogram."""
    base = baselines.filter(F.col(KEY) == "hot").orderBy("feature_pos").collect()
    out = {}
    for key, g in history.groupby(KEY):
        for batch in g[BATCH].unique():
            w = g[g[BATCH] <= batch].tail(OPTIONS.window_size)
            scores = []
            for b in base:
                v, n = w[b["feature_name"]], len(b["expected_distribution"])
                if b["feature_type"] == "numeric":
                    place = np.where(v.isna(), 0, 1 + np.searchsorted(b["cut_points"], v.fillna(0), "left"))
                else:
                    tracked = {t: i + 1 for i, t in enumerate(b["tracked_categories"])}
                    place = [0 if not str(t).strip() else tracked.get(t, n - 1) for t in v]
                scores.append(_psi(np.array(b["expected_distribution"]), np.bincount(place, minlength=n) / len(w)))
            out[key, batch] = (len(w), max(scores) if len(w) >= OPTIONS.min_samples else None)
    return out


@pytest.mark.parametrize("rows_per_block", [1_000_000, 120])
def test_history_equals_rebuilt_windows(rows, baselines, history, rows_per_block):
    found = evaluate_history(rows, baselines, SPEC, OPTIONS, rows_per_block=rows_per_block).collect()
    want = _expected(history, baselines)
    assert len(found) == len(want)
    for r in found:
        size, psi = want[r[KEY], r[BATCH]]
        assert r["window_rows"] == size
        assert r["max_feature_psi"] == (None if psi is None else pytest.approx(psi, abs=1e-9))
        assert r["evaluated"] == (psi is not None)
    assert {r["status"] for r in found} >= {"drift_detected", None}


def test_blocks_follow_the_largest_monitor(spark, rows, baselines, history, monkeypatch):
    """Many monitors of few rows need no blocks, however many rows there are in all."""
    most = int(history.groupby(KEY).size().max())
    found, made = {}, []

    def counted(*args, **kwargs):
        made.append(args[3])
        return positions(*args, **kwargs)

    monkeypatch.setattr("tidemark.operators.monitor.positions", counted)
    for limit in (most, most - 1):
        found[limit] = evaluate_history(rows, baselines, SPEC, OPTIONS, rows_per_block=limit).select(
            KEY, BATCH, "window_rows", "status", F.round("max_feature_psi", 9)).collect()
        assert bool(made) == (limit < most)
    assert most < len(history)
    assert sorted(map(str, found[most])) == sorted(map(str, found[most - 1]))


def test_monitors_without_baseline_are_ignored(rows, baselines):
    found = evaluate_history(rows, baselines.filter(F.col(KEY) != "m1"), SPEC, OPTIONS)
    assert {r[KEY] for r in found.select(KEY).distinct().collect()} == {"hot", "m2"}
    off = DriftOptions(60, 25, 4, 2, 0.1, 0.25, 1, enabled=False)
    assert evaluate_history(rows, baselines, SPEC, off).count() == 0


def test_rolling_window(rows, history):
    got = rolling_window(rows, 17).toPandas().groupby(KEY)[SEQ].apply(set)
    want = history.groupby(KEY).tail(17).groupby(KEY)[SEQ].apply(set)
    assert got.to_dict() == want.to_dict()


def _walk(evaluations, cooldown, fails=frozenset(), started=None):
    """One evaluation after the other, as they arrive."""
    last, out = dict(started or {}), []
    for key, batch, at, status in evaluations:
        if status != "drift_detected":
            out.append((key, batch, False, False, None))
        elif key in last and at - last[key] < timedelta(minutes=cooldown):
            out.append((key, batch, False, False, "cooldown_active"))
        else:
            failed = batch in fails
            if not failed:
                last[key] = at
            out.append((key, batch, True, not failed, "http_error" if failed else "triggered"))
    return out


def _changes(spark, evaluations):
    return spark.createDataFrame(
        [(*e, False) for e in evaluations],
        f"{KEY} string, {BATCH} bigint, evaluated_at timestamp, status string, changed boolean",
    )


@pytest.mark.parametrize("cooldown", [0, 7, 45, 600])
@pytest.mark.parametrize("limits", [{}, {"fold_limit": 1, "rows_per_block": 25}, {"fold_limit": 5}])
def test_cooldown(spark, cooldown, limits):
    rng = np.random.default_rng(cooldown + 1)
    evaluations, at = [], START
    for batch in range(150):
        at += timedelta(minutes=int(rng.choice([0, 1, 5, 30, 200], p=[0.1, 0.4, 0.3, 0.15, 0.05])))
        key = "hot" if rng.random() < 0.8 else "b"
        evaluations.append((key, batch, at, str(rng.choice(["drift_detected", "warning"], p=[0.8, 0.2]))))
    fails = frozenset(range(0, 150, 4))
    outcome = F.when(F.col(BATCH) % 4 == 0, "http_error").otherwise("triggered")
    options = RetrainingOptions(cooldown_minutes=cooldown)
    got = retraining_decisions(_changes(spark, evaluations), options, outcome=outcome, **limits)
    found = [tuple(r) for r in got.select(KEY, BATCH, "attempted", "triggered", "trigger_status").collect()]
    assert sorted(found) == sorted(_walk(evaluations, cooldown, fails))

    # the same evaluations in two parts, the second starting from the state of the first
    done = _walk(evaluations[:70], cooldown, fails)
    times = {(e[0], e[1]): e[2] for e in evaluations}
    last = {d[0]: times[d[0], d[1]] for d in done if d[3]}
    state = spark.createDataFrame(
        [(k, "stable", 1, None, None, t, "x") for k, t in last.items()],
        f"{KEY} string, previous_status string, current_window_rows bigint, last_evaluated_at timestamp, "
        "last_event_id string, last_triggered_at timestamp, last_triggered_event_id string",
    )
    got = retraining_decisions(_changes(spark, evaluations[70:]), options, state, outcome, **limits)
    found = [tuple(r) for r in got.select(KEY, BATCH, "attempted", "triggered", "trigger_status").collect()]
    assert sorted(found) == sorted(_walk(evaluations[70:], cooldown, fails, last))


def test_disabled_and_misconfigured(spark):
    one = _changes(spark, [("a", 0, START, "drift_detected")])
    off = retraining_decisions(one, RetrainingOptions(enabled=False)).first()
    assert (off["attempted"], off["trigger_status"]) == (False, None)
    lost = retraining_decisions(one, RetrainingOptions(workflow_id=None)).first()
    assert (lost["attempted"], lost["triggered"], lost["trigger_status"]) == (True, False, "misconfigured")
    silent = retraining_decisions(one, RetrainingOptions(), outcome=F.lit("disabled")).first()
    assert (silent["attempted"], silent["trigger_status"]) == (False, "disabled")


def test_ten_drifted_rows_give_one_event(spark):
    reference = spark.range(24).select(
        (F.col("id") * 3 + 1).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("z"),
        F.lit("Month-to-month").alias("c"),
    )
    options = DriftOptions(10, 10, 5, 5, 0.02, 0.05, 1)
    models = spark.createDataFrame([("run_1",)], f"{KEY} string")
    baselines = attach_baseline(models, build_baseline(reference, SPEC, options))
    batch = spark.range(10).select(
        F.lit("run_1").alias(KEY), F.lit(0).cast("bigint").alias(BATCH), F.col("id").alias(SEQ),
        F.lit(START).alias(AT), F.lit(240.0).alias("x"), F.lit(1.0).alias("z"), F.lit("Two year").alias("c"),
    )
    found = evaluate_history(batch, baselines, SPEC, options).cache()
    retraining = RetrainingOptions(cooldown_minutes=30)
    decisions = decide(found, retraining).cache()
    (event,) = drift_events(decisions, options, retraining).collect()
    assert (event["status"], event["trigger_status"]) == ("drift_detected", "triggered")
    assert event["event_id"] == "20240101T000000000000Z_drift_detected"
    assert retraining_requests(decisions, retraining).first()["request_run_id"] == "drift__20240101T000000000000Z"
    state = monitor_states(found, decisions).first()
    assert state["current_window_rows"] == 10
    assert state["last_triggered_event_id"] == event["event_id"]


def _events(df):
    names = [KEY, BATCH, "event_id", "status", "previous_status", "trigger_status", "payload"]
    return sorted(map(tuple, df.select(*names).collect()))


def test_stream_equals_history(spark, rows, baselines, history):
    whole = decide(evaluate_history(rows, baselines, SPEC, OPTIONS), RETRAINING)
    want = _events(drift_events(whole, OPTIONS, RETRAINING))
    assert len(want) > 2
    source, root, seen = new_folder(spark, "src"), new_folder(spark, "out"), []
    for low, high in ((0, 13), (13, 14), (14, 37), (37, 60)):
        part = rows.filter((F.col(BATCH) >= low) & (F.col(BATCH) < high))
        part.coalesce(1).write.mode("append").parquet(source)
    monitor = MonitorStream(root, baselines, SPEC, OPTIONS, RETRAINING, rows_per_block=150,
                            on_decision=lambda df, batch: seen.append((batch, df.count())))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    monitor.start(stream, new_folder(spark, "cp")).awaitTermination()
    assert _events(read_monitor_table(spark, root, "events")) == want
    assert [b for b, _ in seen] == [0, 1, 2, 3]
    states = monitor.latest(spark)
    found = evaluate_history(rows, baselines, SPEC, OPTIONS).cache()
    assert sorted(states.collect()) == sorted(monitor_states(found, whole).collect())

    # a replayed micro-batch leaves everything as it was
    last = rows.filter(F.col(BATCH) >= 37)
    monitor.process(last, 3)
    assert _events(read_monitor_table(spark, root, "events")) == want
    assert seen[-1] == seen[-2]
    kept = history.groupby(KEY).size().clip(upper=OPTIONS.window_size).sum()
    assert monitor.latest(spark, "window").count() == kept
