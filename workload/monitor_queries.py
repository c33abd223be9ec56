"""Rolling windows, monitor history, retraining decisions and the monitoring stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import event_id
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
    status_changes,
)
from tidemark.operators.outbox import decide_with_deliveries, request_key
from tidemark.options import DriftOptions, FeatureSpec, RetrainingOptions
from tidemark.session import cut_lineage, new_folder
from tidemark.sources.commit_log import CommitLog
from tidemark.streaming.monitor import MonitorStream, read_monitor_table
from workload import query, table
from workload.drift_queries import bucket_sql, edges_sql

SPEC = FeatureSpec(("value",), ("event_type",))
OPTIONS = DriftOptions(
    window_size=200, min_samples=100, warning_threshold=0.1, drift_threshold=0.2, min_drifted_features=1
)
RETRAINING = RetrainingOptions(cooldown_minutes=2880)


def observations(spark, sf):
    """Events as scored records: groups of 50 users are one model, 100 events one batch.

    In the second half of the month every other stretch of 1500 events has larger
    values, so all statuses and recoveries occur.
    """
    ev = table(spark, sf, "events")
    shifted = (F.col("ts") >= F.lit("2024-01-11").cast("timestamp_ntz")) & (
        F.floor(F.col("event_id") / 1500) % 2 == 1
    )
    return ev.select(
        F.concat(F.lit("run_"), F.floor(F.col("user_id") / 50)).alias(KEY),
        F.floor(F.col("event_id") / 100).alias(BATCH),
        F.col("event_id").alias(SEQ),
        F.col("ts").cast("timestamp").alias(AT),
        F.when(shifted, F.col("value") * 2).otherwise(F.col("value")).alias("value"),
        "event_type",
    )


def baselines(spark, sf):
    """The same baseline for every model that served in the first days."""
    ev = table(spark, sf, "events").filter(F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz"))
    served = ev.select(F.concat(F.lit("run_"), F.floor(F.col("user_id") / 50)).alias(KEY)).distinct()
    return cut_lineage(attach_baseline(served, build_baseline(ev, SPEC, OPTIONS)))


_EVALUATIONS = f"""
    ev AS (SELECT 'run_' || (user_id // 50) AS monitor_key, event_id // 100 AS batch_id, event_id AS seq, ts,
                  CASE WHEN ts >= TIMESTAMP '2024-01-11' AND (event_id // 1500) % 2 = 1 THEN value * 2
                       ELSE value END AS value, event_type FROM events),
    base AS (SELECT value, event_type FROM events WHERE ts < TIMESTAMP '2024-01-11'),
    e AS ({edges_sql('base', 'value', 10)}),
    tr AS (SELECT list(event_type ORDER BY c DESC, event_type) AS tracked FROM
             (SELECT event_type, count(*) AS c FROM base GROUP BY 1 ORDER BY c DESC, event_type LIMIT 10)),
    bb AS (SELECT unnest([struct_pack(f := 0, b := {bucket_sql('value', '(SELECT cuts FROM e)')}),
             struct_pack(f := 1, b := coalesce(nullif(list_position((SELECT tracked FROM tr), event_type), 0),
                                               (SELECT len(tracked) + 1 FROM tr)))], recursive := true) FROM base),
    g AS (SELECT 0 AS f, b FROM range(0, 12) r(b) WHERE b < (SELECT len(cuts) + 2 FROM e)
          UNION ALL SELECT 1, b FROM range(0, 12) r(b) WHERE b < (SELECT len(tracked) + 2 FROM tr)),
    ex AS (SELECT g.f, g.b, greatest(count(bb.b) / CAST((SELECT count(*) FROM base) AS DOUBLE), 1e-6::DOUBLE) AS share
           FROM g LEFT JOIN bb ON bb.f = g.f AND bb.b = g.b GROUP BY 1, 2),
    rows_ AS (SELECT monitor_key, batch_id, ts, row_number() OVER (PARTITION BY monitor_key ORDER BY seq) AS pos,
                {bucket_sql('value', '(SELECT cuts FROM e)')} AS b0,
                coalesce(nullif(list_position((SELECT tracked FROM tr), event_type), 0),
                         (SELECT len(tracked) + 1 FROM tr)) AS b1 FROM ev),
    batches AS (SELECT monitor_key, batch_id, max(pos) AS last_pos, max(ts) AS evaluated_at FROM rows_ GROUP BY 1, 2),
    w AS (SELECT q.monitor_key, q.batch_id, r.b0, r.b1 FROM batches q JOIN rows_ r ON r.monitor_key = q.monitor_key
            AND r.pos <= q.last_pos AND r.pos > q.last_pos - 200),
    h AS (SELECT monitor_key, batch_id, 0 AS f, b0 AS b, count(*) AS c FROM w GROUP BY ALL
          UNION ALL SELECT monitor_key, batch_id, 1, b1, count(*) FROM w GROUP BY ALL),
    p AS (SELECT q.monitor_key, q.batch_id, ex.f,
            sum((greatest(coalesce(h.c, 0) / CAST(least(q.last_pos, 200) AS DOUBLE), 1e-6::DOUBLE) - share)
                * ln(greatest(coalesce(h.c, 0) / CAST(least(q.last_pos, 200) AS DOUBLE), 1e-6::DOUBLE) / share)) AS psi
          FROM batches q CROSS JOIN ex LEFT JOIN h ON h.monitor_key = q.monitor_key AND h.batch_id = q.batch_id
               AND h.f = ex.f AND h.b = ex.b GROUP BY 1, 2, 3),
    s AS (SELECT monitor_key, batch_id, max(psi) AS psi, count(*) FILTER (psi >= 0.2) AS d,
                 count(*) FILTER (psi >= 0.1 AND psi < 0.2) AS w,
                 coalesce(string_agg(CASE WHEN f = 0 THEN 'value' ELSE 'event_type' END, ',' ORDER BY psi DESC, f)
                   FILTER (psi >= 0.2), '') AS drifted,
                 coalesce(string_agg(CASE WHEN f = 0 THEN 'value' ELSE 'event_type' END, ',' ORDER BY psi DESC, f)
                   FILTER (psi >= 0.1), '') AS alerted
          FROM p GROUP BY 1, 2),
    evaluations AS (SELECT q.monitor_key, q.batch_id, q.evaluated_at, least(q.last_pos, 200) AS window_rows,
            CASE WHEN last_pos >= 100 THEN CASE WHEN d >= 1 THEN 'drift_detected' WHEN d + w > 0 THEN 'warning'
                                           ELSE 'stable' END END AS status,
            CASE WHEN last_pos >= 100 THEN psi END AS psi, drifted, alerted
          FROM batches q JOIN s USING (monitor_key, batch_id)),
    changes AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY monitor_key ORDER BY batch_id), 'stable') AS previous_status
          FROM evaluations WHERE status IS NOT NULL)
"""

# Walk through the drifted evaluations of each monitor with the time of the last trigger.
_DECISIONS = f"""
    WITH RECURSIVE {_EVALUATIONS},
    d AS (SELECT monitor_key, batch_id, evaluated_at,
                 row_number() OVER (PARTITION BY monitor_key ORDER BY batch_id) AS i
          FROM changes WHERE status = 'drift_detected'),
    walk AS (
      SELECT monitor_key, batch_id, i, evaluated_at AS last_trigger, true AS attempted FROM d WHERE i = 1
      UNION ALL
      SELECT d.monitor_key, d.batch_id, d.i,
             CASE WHEN d.evaluated_at - walk.last_trigger >= INTERVAL 2880 MINUTE THEN d.evaluated_at
                  ELSE walk.last_trigger END,
             d.evaluated_at - walk.last_trigger >= INTERVAL 2880 MINUTE
      FROM walk JOIN d ON d.monitor_key = walk.monitor_key AND d.i = walk.i + 1),
    decisions AS (
      SELECT c.*, coalesce(walk.attempted, false) AS attempted,
             CASE WHEN walk.attempted THEN 'triggered' WHEN walk.i IS NOT NULL THEN 'cooldown_active' END AS trigger_status
      FROM changes c LEFT JOIN walk USING (monitor_key, batch_id))
"""

_AT = "strftime(evaluated_at, '%Y-%m-%d %H:%M:%S.%f')"
_ID = "strftime(evaluated_at, '%Y%m%dT%H%M%S%fZ') || '_' || status"


def _evaluations(spark, sf):
    return evaluate_history(observations(spark, sf), baselines(spark, sf), SPEC, OPTIONS)


def _decisions(spark, sf):
    return decide(_evaluations(spark, sf), RETRAINING)


def _text(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query(
    "rolling_window",
    """
    SELECT 'run_' || (user_id // 50) AS monitor_key, event_id AS seq, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id // 50 ORDER BY event_id DESC) <= 200
    """,
)
def rolling_window_query(spark, sf):
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("run_"), F.floor(F.col("user_id") / 50)).alias(KEY),
        F.col("event_id").alias(SEQ), "value",
    )
    return rolling_window(rows, 200)


@query(
    "monitor_evaluations",
    f"""
    WITH {_EVALUATIONS}
    SELECT monitor_key, batch_id, {_AT} AS evaluated_at, window_rows, status, round(psi, 6) AS max_feature_psi
    FROM evaluations
    """,
)
def monitor_evaluations(spark, sf):
    return _evaluations(spark, sf).select(
        KEY, BATCH, _text("evaluated_at").alias("evaluated_at"), "window_rows", "status",
        F.round("max_feature_psi", 6).alias("max_feature_psi"),
    )


@query(
    "monitor_status",
    f"WITH {_EVALUATIONS} SELECT monitor_key, batch_id, status, previous_status, "
    "status <> previous_status AS changed FROM changes",
)
def monitor_status(spark, sf):
    changes = status_changes(cut_lineage(_evaluations(spark, sf)))
    return changes.select(KEY, BATCH, "status", "previous_status", "changed")


@query(
    "retraining_decisions",
    _DECISIONS + "SELECT monitor_key, batch_id, attempted, attempted AS triggered, trigger_status FROM decisions",
)
def retraining_decisions_query(spark, sf):
    return _decisions(spark, sf).select(KEY, BATCH, "attempted", "triggered", "trigger_status")


@query(
    "retraining_decisions_blocks",
    _DECISIONS + "SELECT monitor_key, batch_id, attempted, trigger_status FROM decisions",
)
def retraining_decisions_blocks(spark, sf):
    """The same decisions through small blocks and pointer doubling."""
    changes = status_changes(cut_lineage(_evaluations(spark, sf)))
    decided = retraining_decisions(changes, RETRAINING, fold_limit=1, rows_per_block=50)
    return decided.select(KEY, BATCH, "attempted", "trigger_status")


@query(
    "monitor_events",
    _DECISIONS
    + f"""SELECT monitor_key, batch_id, {_ID} AS event_id, status, previous_status, trigger_status,
                 drifted AS drifted_features, alerted AS alert_features, round(psi, 6) AS max_feature_psi
          FROM decisions WHERE attempted OR status <> previous_status""",
)
def monitor_events(spark, sf):
    return _event_rows(drift_events(_decisions(spark, sf), OPTIONS, RETRAINING))


def _event_rows(events):
    return events.select(
        KEY, BATCH, "event_id", "status", "previous_status", "trigger_status",
        F.array_join("drifted_features", ",").alias("drifted_features"),
        F.array_join("alert_features", ",").alias("alert_features"),
        F.round("max_feature_psi", 6).alias("max_feature_psi"),
    )


_REQUESTS = """SELECT monitor_key, 'drift__' || strftime(evaluated_at, '%Y%m%dT%H%M%S%fZ') AS request_run_id,
    'model_training' AS workflow_id, 'triggered' AS outcome, window_rows AS observed_sample_size
    FROM decisions WHERE attempted"""


def watched_models(spark, sf):
    """What each monitor watches, as a table."""
    return baselines(spark, sf).groupBy(KEY).agg(F.lit("run_table").alias("source_type")).select(
        KEY, F.concat(F.lit("m-"), F.col(KEY)).alias("model_name"), "source_type",
        F.concat(F.lit("runs:/"), F.col(KEY), F.lit("/model")).alias("source_uri"),
        F.substring(KEY, 5, 100).alias("training_run_id"),
        F.lit(None).cast("string").alias("registered_model_name"),
        F.lit(None).cast("string").alias("registered_model_version"),
    )


@query("retraining_requests", _DECISIONS + _REQUESTS)
def retraining_requests_query(spark, sf):
    return _request_rows(retraining_requests(_decisions(spark, sf), RETRAINING))


def _request_rows(requests):
    return requests.select(
        KEY, "request_run_id", "workflow_id", "outcome",
        F.get_json_object("conf", "$.observed_sample_size").cast("bigint").alias("observed_sample_size"),
    )


_STATES = f"""
    SELECT b.monitor_key, 'run_table' AS model_source, b.current_window_rows,
           coalesce(d.previous_status, 'stable') AS previous_status,
           d.last_evaluated_at, d.last_event_id, d.last_triggered_event_id
    FROM (SELECT monitor_key, max_by(window_rows, batch_id) AS current_window_rows FROM evaluations GROUP BY 1) b
    LEFT JOIN (SELECT monitor_key, max_by(status, batch_id) AS previous_status,
                 max({_AT}) AS last_evaluated_at,
                 max_by({_ID}, batch_id) FILTER (attempted OR status <> previous_status) AS last_event_id,
                 max_by({_ID}, batch_id) FILTER (attempted) AS last_triggered_event_id
               FROM decisions GROUP BY 1) d USING (monitor_key)
"""


@query("monitor_states", _DECISIONS + _STATES)
def monitor_states_query(spark, sf):
    found = cut_lineage(_evaluations(spark, sf))
    models = watched_models(spark, sf)
    return _state_rows(monitor_states(found, decide(found, RETRAINING, stored=True), models=models))


def _state_rows(states):
    return states.select(
        KEY, "model_source", "current_window_rows", "previous_status",
        _text("last_evaluated_at").alias("last_evaluated_at"), "last_event_id",
        "last_triggered_event_id",
    )


_FAILING = _DECISIONS.replace(
    "SELECT monitor_key, batch_id, i, evaluated_at AS last_trigger, true AS attempted FROM d WHERE i = 1",
    "SELECT monitor_key, batch_id, i, CASE WHEN batch_id % 3 <> 0 THEN evaluated_at ELSE TIMESTAMP '1970-01-01' END"
    " AS last_trigger, true AS attempted FROM d WHERE i = 1",
).replace(
    "CASE WHEN d.evaluated_at - walk.last_trigger >= INTERVAL 2880 MINUTE THEN d.evaluated_at",
    "CASE WHEN d.evaluated_at - walk.last_trigger >= INTERVAL 2880 MINUTE AND d.batch_id % 3 <> 0 THEN d.evaluated_at",
)


@query(
    "retraining_failures",
    _FAILING
    + """SELECT monitor_key, batch_id, attempted, attempted AND batch_id % 3 <> 0 AS triggered,
                CASE WHEN attempted AND batch_id % 3 = 0 THEN 'http_error' ELSE trigger_status END AS trigger_status
         FROM decisions""",
)
def retraining_failures(spark, sf):
    """A delivery that fails on every third batch: failures start no cooldown."""
    outcome = F.when(F.col(BATCH) % 3 == 0, "http_error").otherwise("triggered")
    decided = decide(_evaluations(spark, sf), RETRAINING, outcome=outcome)
    return decided.select(KEY, BATCH, "attempted", "triggered", "trigger_status")


def run_monitor_stream(spark, sf, rows=None, chunks=3, **settings):
    """Stream the observations in ``chunks`` appends through the monitor, which is returned."""
    source, root = new_folder(spark, "observations"), new_folder(spark, "monitor")
    rows = observations(spark, sf) if rows is None else rows
    last = rows.agg(F.max(BATCH).alias("b")).first()["b"]
    step = -(-(last + 1) // chunks)
    monitor = MonitorStream(root, baselines(spark, sf), SPEC, OPTIONS, RETRAINING, **settings)
    progress = new_folder(spark, "stream-checkpoint")
    for i in range(chunks):
        part = rows.filter((F.col(BATCH) >= i * step) & (F.col(BATCH) < (i + 1) * step))
        part.write.mode("append").parquet(source)
        # the stream takes all that is new as one micro-batch and goes on from where it was
        stream = spark.readStream.schema(rows.schema).parquet(source)
        monitor.start(stream, progress).awaitTermination()
    return monitor


@query(
    "monitor_stream",
    _DECISIONS
    + f"""SELECT monitor_key, batch_id, {_ID} AS event_id, status, previous_status, trigger_status,
                 drifted AS drifted_features, alerted AS alert_features, round(psi, 6) AS max_feature_psi
          FROM decisions WHERE attempted OR status <> previous_status""",
)
def monitor_stream(spark, sf):
    return _event_rows(read_monitor_table(spark, run_monitor_stream(spark, sf).root, "events"))


@query("monitor_stream_late", _DECISIONS + _STATES)
def monitor_stream_late(spark, sf):
    """States after a stream whose later batches bring smaller ``seq``: the order of arrival counts."""
    rows = observations(spark, sf)
    last = rows.agg(F.max(BATCH).alias("b")).first()["b"]
    late = rows.withColumn(SEQ, F.col(SEQ) % 100 + 100 * (F.lit(last) - F.col(BATCH)))
    monitor = run_monitor_stream(spark, sf, late, chunks=2, models=watched_models(spark, sf))
    return _state_rows(monitor.latest(spark))


@query(
    "state_log",
    """SELECT user_id, CAST(max(event_id) AS BIGINT) AS event_id,
              max_by(event_type, event_id) AS event_type, CAST(max(event_id) // s AS BIGINT) AS written
       FROM events, (SELECT (max(event_id) + 20) // 20 AS s FROM events) GROUP BY user_id, s""",
)
def state_log(spark, sf):
    """The last event of every user, kept by twenty micro-batches that each touch some users."""
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    step = (events.agg(F.max("event_id").alias("m")).first()["m"] + 20) // 20
    log = CommitLog(spark, new_folder(spark, "state-log"), "user_id", buckets=16, compact_after=4)
    live = {}
    for version in range(20):
        part = events.filter(F.floor(F.col("event_id") / step) == version)
        last = cut_lineage(part.groupBy("user_id").agg(
            F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"),
        ).withColumn("written", F.lit(version).cast("bigint")))
        touched = last.agg(F.collect_set(log.bucket()).alias("b")).first()["b"]
        live = {**live, **log.write("last_event", version, last, live, touched)}
        log.commit(version, live)
    return log.read("last_event", log.live(log.newest()))


_DELIVERED = _FAILING + f""", answers AS (
      SELECT *, {_ID} AS event_id, attempted AND batch_id % 3 <> 0 AS triggered,
             CASE WHEN attempted AND batch_id % 3 = 0 THEN 'http_error' ELSE trigger_status END AS answer
      FROM decisions)
"""


def _delivered(spark, sf):
    """Decisions after deliveries: every third batch is refused twice, others answer the second attempt.

    Attempts stand twice in the table, as from a sender that was killed.
    """
    found = cut_lineage(_evaluations(spark, sf))
    refused = F.col(BATCH) % 3 == 0
    second = F.col("attempt") == 2
    sent = found.filter(F.col("status") == "drift_detected").select(
        BATCH, request_key(event_id("evaluated_at", "status")).alias("request_key"), "evaluated_at",
        F.explode(F.array(F.lit(1), F.lit(2), F.lit(2))).alias("attempt"),
    ).select(
        "request_key", "attempt", (F.col("evaluated_at") + F.make_interval(mins="attempt")).alias("delivered_at"),
        F.concat(F.lit("https://workflows.example/"), "attempt").alias("request_url"),
        F.when(refused, F.lit(503)).when(second, F.lit(201)).alias("status_code"),
        F.when(refused, "busy").when(second, "started").otherwise("timed out").alias("detail"),
    )
    return decide_with_deliveries(found, RETRAINING, sent)


@query(
    "delivery_results",
    _DELIVERED
    + """SELECT monitor_key, batch_id, attempted, triggered, answer AS trigger_status,
                sha256(monitor_key || '|' || event_id) AS request_key FROM answers""",
)
def delivery_results_query(spark, sf):
    """Decisions with the answers of an outbox: requests that were refused start no cooldown."""
    return _delivered(spark, sf).select(KEY, BATCH, "attempted", "triggered", "trigger_status", "request_key")


@query(
    "event_payloads",
    _DELIVERED
    + """SELECT event_id, monitor_key, status, window_rows AS observed_sample_size,
                round(psi, 6) AS max_feature_psi, 'm-' || monitor_key AS model_name, '0.2' AS drift_threshold,
                CASE WHEN answer IS NOT NULL THEN attempted::VARCHAR END AS attempted,
                CASE WHEN answer IS NOT NULL THEN triggered::VARCHAR END AS triggered, answer AS trigger_status,
                CASE WHEN answer IS NOT NULL THEN 'request_table' END AS backend,
                CASE WHEN answer IS NOT NULL THEN 'model_training' END AS workflow_id,
                CASE WHEN attempted THEN 'drift__' || strftime(evaluated_at, '%Y%m%dT%H%M%S%fZ') END AS run_id,
                CASE WHEN attempted THEN 'https://workflows.example/2' END AS request_url,
                CASE WHEN attempted THEN CASE WHEN batch_id % 3 = 0 THEN 503 ELSE 201 END END AS response_status_code,
                CASE WHEN attempted THEN CASE WHEN batch_id % 3 = 0 THEN 'busy' ELSE 'started' END END AS detail
         FROM answers WHERE attempted OR status <> previous_status""",
)
def event_payloads(spark, sf):
    """Events read back from their JSON documents, with every field of the trigger."""
    events = drift_events(_delivered(spark, sf), OPTIONS, RETRAINING, watched_models(spark, sf))

    def at(path):
        return F.get_json_object("payload", path)

    trigger = ("attempted", "triggered", "backend", "workflow_id", "run_id", "request_url", "detail")
    return events.select(
        at("$.event_id").alias("event_id"), at("$.monitor_key").alias(KEY),
        at("$.evaluation.status").alias("status"),
        at("$.evaluation.observed_sample_size").cast("bigint").alias("observed_sample_size"),
        F.round(at("$.evaluation.max_feature_psi").cast("double"), 6).alias("max_feature_psi"),
        at("$.model.model_name").alias("model_name"),
        at("$.thresholds.drift_threshold").alias("drift_threshold"),
        at("$.retraining_trigger.status").alias("trigger_status"),
        at("$.retraining_trigger.response_status_code").cast("int").alias("response_status_code"),
        *[at(f"$.retraining_trigger.{f}").alias(f) for f in trigger],
    )
