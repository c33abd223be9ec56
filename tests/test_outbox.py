"""Deliveries folded into decisions, against a walk through them in order."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.monitor import BATCH, KEY, drift_events, retraining_requests
from tidemark.operators.outbox import (
    DELIVERY_SCHEMA,
    Outbox,
    decide_with_deliveries,
    delivery_results,
)
from tidemark.options import DriftOptions, RetrainingOptions
from tidemark.session import new_folder

START = datetime(2024, 1, 1)
EVALUATIONS = (
    f"{KEY} string, {BATCH} bigint, evaluated_at timestamp, status string, window_rows bigint, evaluated boolean, "
    "drifted_feature_count int, warning_feature_count int, max_feature_psi double, drifted_features array<string>, "
    "alert_features array<string>, feature_results array<string>"
)


def _key(monitor, at, status):
    event = at.strftime("%Y%m%dT%H%M%S%fZ") + "_" + status
    return hashlib.sha256(f"{monitor}|{event}".encode()).hexdigest()


def _evaluations(spark, rows):
    more = (100, True, 1, 0, 0.5, ["x"], [], [])
    return spark.createDataFrame([(*r, *more) for r in rows], EVALUATIONS)


def _result(rows):
    """The attempt that counts: the first success, else the last one; of repeats the earliest."""
    good = [r for r in rows if r[4] is not None and 200 <= r[4] < 300]
    picked = min(good, key=lambda r: (r[1], r[2])) if good else min(rows, key=lambda r: (-r[1], r[2]))
    outcome = "triggered" if good else "request_error" if picked[4] is None else "http_error"
    return max(r[1] for r in rows), outcome, picked[4], picked[5]


@pytest.fixture(scope="module")
def case():
    rng = np.random.default_rng(3)
    rows, deliveries, at = [], [], START
    for batch in range(120):
        at += timedelta(minutes=int(rng.choice([5, 30, 200])))
        key = "hot" if rng.random() < 0.7 else "b"
        status = str(rng.choice(["drift_detected", "warning"], p=[0.8, 0.2]))
        rows.append((key, batch, at, status))
        for attempt in range(1, int(rng.integers(0, 4)) + 1):
            code = [200, 299, 503, 404, None][int(rng.integers(0, 5))]
            for again in range(int(rng.integers(1, 3))):
                deliveries.append((_key(key, at, status), attempt, at + timedelta(seconds=attempt + again),
                                   "https://x", code, f"{code} {again}"))
    order = rng.permutation(len(deliveries))
    return rows, [deliveries[i] for i in order] + [(None, 1, START, "x", 200, "x"), ("never made", 1, START, "x", 200, "")]


def test_results_of_deliveries(spark, case):
    _, deliveries = case
    df = spark.createDataFrame(deliveries, DELIVERY_SCHEMA)
    got = {r["request_key"]: tuple(r["delivery"][f] for f in ("attempts", "outcome", "status_code", "detail"))
           for r in delivery_results(df).collect()}
    keys = {d[0] for d in deliveries if d[0]}
    assert got == {k: _result([d for d in deliveries if d[0] == k]) for k in keys}
    assert delivery_results(df.limit(0)).count() == 0


@pytest.mark.parametrize("cooldown", [0, 45, 600])
def test_decisions_with_deliveries(spark, case, cooldown):
    rows, deliveries = case
    results = {k: _result([d for d in deliveries if d[0] == k]) for k in {d[0] for d in deliveries}}
    last, want = {}, []
    for monitor, batch, at, status in rows:
        if status != "drift_detected":
            want.append((monitor, batch, False, False, None))
        elif monitor in last and at - last[monitor] < timedelta(minutes=cooldown):
            want.append((monitor, batch, False, False, "cooldown_active"))
        else:
            result = results.get(_key(monitor, at, status))
            outcome = result[1] if result else "queued"
            if outcome in ("queued", "triggered"):
                last[monitor] = at
            want.append((monitor, batch, True, outcome == "triggered", outcome))
    got = decide_with_deliveries(_evaluations(spark, rows), RetrainingOptions(cooldown_minutes=cooldown),
                                 spark.createDataFrame(deliveries, DELIVERY_SCHEMA))
    assert sorted(tuple(r) for r in got.select(KEY, BATCH, "attempted", "triggered", "trigger_status").collect()) \
        == sorted(want)


def test_outbox_from_request_to_event(spark):
    at = [START + timedelta(hours=10 * i) for i in range(3)]
    found = _evaluations(spark, [("m", i, t, "drift_detected") for i, t in enumerate(at)])
    options = RetrainingOptions(cooldown_minutes=15 * 60)
    box = Outbox(spark, new_folder(spark, "outbox"))
    assert box.due(2) is None

    def advance(part):
        decided = decide_with_deliveries(found, options, box.deliveries())
        box.enqueue(part, retraining_requests(decided, options))
        box.enqueue(part, retraining_requests(decided, options))  # killed and written again
        return [r["trigger_status"] for r in decided.orderBy(BATCH).collect()]

    def due():
        return sorted((r[BATCH], r["next_attempt"]) for r in box.due(2).collect())

    keys = [_key("m", t, "drift_detected") for t in at]
    assert advance(0) == ["queued", "cooldown_active", "queued"] and due() == [(0, 1), (2, 1)]
    answers = [(keys[0], 1, at[0], "https://x/runs", 500, "no"), (keys[2], 1, at[2], "https://x/runs", 201, "yes")]
    box.record(0, spark.createDataFrame(answers, DELIVERY_SCHEMA))
    # the first request is refused, so the second drift asks; its queued request holds the third
    assert advance(1) == ["http_error", "queued", "cooldown_active"] and due() == [(0, 2), (1, 1)]
    again = [(keys[0], 2, at[1], "https://x/runs", None, "timed out")]
    box.record(1, spark.createDataFrame(again, DELIVERY_SCHEMA))
    assert due() == [(1, 1)] and box.requests().count() == 3
    decided = decide_with_deliveries(found, options, box.deliveries())
    events = drift_events(decided, DriftOptions(), options).orderBy(BATCH).collect()
    first = json.loads(events[0]["payload"])["retraining_trigger"]
    assert first == {
        "attempted": True, "triggered": False, "status": "request_error", "backend": "request_table",
        "workflow_id": "model_training", "run_id": "drift__20240101T000000000000Z", "request_url": "https://x/runs",
        "response_status_code": None, "detail": "timed out",
    }
    lost = RetrainingOptions(workflow_id=None)
    decided = decide_with_deliveries(found.filter(F.col(BATCH) == 0), lost, box.deliveries())
    told = json.loads(drift_events(decided, DriftOptions(), lost).first()["payload"])["retraining_trigger"]
    assert (told["status"], told["run_id"], told["detail"]) == ("misconfigured", None, "no workflow is configured")
