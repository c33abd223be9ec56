"""Drift monitoring over a rolling window of the last N rows per monitored model.

Observations arrive in batches. After each batch the window holds the last
``window_size`` rows of the monitor, and its histogram is compared with the
baseline. Histograms are never rebuilt per batch: a row adds one to its buckets
in the batch that brings it in and takes one away in the batch that pushes it
out, and running sums of these changes are the window histograms.

The same functions serve history in one go and micro-batches: carried window
rows and monitor states are plain tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import MISSING, col, event_id, stamp
from tidemark.functions.distributions import (
    category_bucket,
    feature_status,
    numeric_bucket,
    overall_status,
    psi_of_columns,
)
from tidemark.operators.baseline import category_value, numeric_value
from tidemark.options import DriftOptions, FeatureSpec, RetrainingOptions
from tidemark.plans.lookup import lookup_join
from tidemark.plans.ordered import ROWS_PER_BLOCK, block_edges, positions, previous, running
from tidemark.session import cut_lineage

KEY, BATCH, SEQ, AT = "monitor_key", "batch_id", "seq", "observed_at"
CARRIED = -1  # batch number of rows that were in the window before the first new batch
SALTS = 64
FOLD_LIMIT = 4_096

# --- fixed values -----------------------------------------------------------
INITIAL_STATUS = "stable"
DRIFTED = "drift_detected"
TRIGGERED = "triggered"
COOLDOWN = "cooldown_active"
MISCONFIGURED = "misconfigured"
# ----------------------------------------------------------------------------

STATE_SCHEMA = (
    "monitor_key string, model_source string, previous_status string, current_window_rows bigint, "
    "last_evaluated_at timestamp, last_event_id string, last_triggered_at timestamp, "
    "last_triggered_event_id string"
)


def rolling_window(df: DataFrame, window_size: int, key: str = KEY, seq: str = SEQ) -> DataFrame:
    """Last ``window_size`` rows of every monitor.

    A task that reads rows passes on at most ``window_size`` of a monitor. These
    are ranked per group of reading tasks, so a busy monitor is spread as well
    and only ``SALTS * window_size`` rows meet in the last step.
    """
    newest = col(seq).desc()
    salted = df.withColumn("__salt", F.spark_partition_id() % SALTS)
    part = Window.partitionBy(col(key), "__salt").orderBy(newest)
    whole = Window.partitionBy(col(key)).orderBy(newest)
    return (
        salted.withColumn("__rn", F.row_number().over(part))
        .filter(F.col("__rn") <= window_size)
        .withColumn("__rn", F.row_number().over(whole))
        .filter(F.col("__rn") <= window_size)
        .drop("__salt", "__rn")
    )


def _bucket_columns(baselines: DataFrame, spec: FeatureSpec) -> DataFrame:
    """One row per monitor with the bucket definition of every feature."""
    labels = F.concat(F.array(F.lit(MISSING)), F.col("tracked_categories"))
    definition = F.struct("feature_pos", "cut_points", labels.alias("labels"))
    return baselines.groupBy(KEY).agg(
        *[
            F.max(F.when(F.col("feature_name") == name, definition)).alias(f"__def{i}")
            for i, name in enumerate(spec.all)
        ]
    )


def _bucketed(
    observations: DataFrame, baselines: DataFrame, spec: FeatureSpec, at_most: int
) -> DataFrame:
    """Observations with one array of (feature, bucket); monitors without baseline drop out."""
    joined = lookup_join(
        observations, _bucket_columns(baselines, spec), [KEY], spread_by=[SEQ], at_most=at_most
    )
    cells = []
    for i, name in enumerate(spec.all):
        given = F.col(f"__def{i}")
        if name in spec.numeric:
            bucket = numeric_bucket(numeric_value(observations, name), given["cut_points"])
        else:
            bucket = category_bucket(category_value(observations, name), given["labels"])
        cells.append(
            F.when(
                given.isNotNull(),
                F.struct(given["feature_pos"].alias("feature_pos"), bucket.alias("bucket")),
            )
        )
    return joined.select(KEY, BATCH, SEQ, AT, F.array_compact(F.array(*cells)).alias("cells"))


def evaluate_history(
    observations: DataFrame,
    baselines: DataFrame,
    spec: FeatureSpec,
    options: DriftOptions,
    carried: DataFrame | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
    at_most: int | None = None,
) -> DataFrame:
    """One row per (monitor, batch): window rows and, past ``min_samples``, the evaluation.

    ``seq`` orders the rows of a monitor and must not go back between batches
    (see ``arrival_order``). ``carried`` holds window rows from before, with the
    same columns; ``at_most`` is a number of a monitor's rows known not to be exceeded.
    Blocks are made only if a monitor has more than ``rows_per_block`` rows.
    """
    names = [KEY, BATCH, SEQ, AT, *spec.all]
    if not options.enabled:
        observations = observations.filter(F.lit(False))
    rows = observations.select(*[col(n) for n in names if n in observations.columns])
    if carried is not None:
        old = carried.withColumn(BATCH, F.lit(CARRIED).cast("bigint")).select(
            *[col(n) for n in rows.columns]
        )
        rows = rows.unionByName(old)
    known = baselines.agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.size("expected_distribution")).alias("buckets")
    ).first()
    buckets = known["buckets"] or 1

    seq_edges = block_edges(rows, SEQ, rows_per_block, at_most, [KEY])
    batch_edges = block_edges(rows, BATCH, rows_per_block) if seq_edges else []
    bucketed = _bucketed(rows, baselines, spec, known["rows"])
    # the row at pos + N pushes out the row at pos
    if seq_edges:
        placed = positions(bucketed, [KEY], SEQ, "pos", edges=seq_edges)
        slim = lookup_join(
            rows.select(KEY, BATCH, SEQ), baselines.select(KEY).distinct(), [KEY], "left_semi",
            at_most=known["rows"],
        )
        pushed = positions(slim, [KEY], SEQ, "pos", edges=seq_edges).select(
            KEY, (F.col("pos") - options.window_size).alias("pos"), F.col(BATCH).alias("leaves")
        )
        flow = placed.join(pushed.filter(F.col("pos") > 0), [KEY, "pos"], "left")
    else:  # few rows of each monitor: the window that ranks them looks ahead as well
        order = Window.partitionBy(KEY).orderBy(SEQ)
        flow = bucketed.withColumns({
            "pos": F.row_number().over(order).cast("bigint"),
            "leaves": F.lead(BATCH, options.window_size).over(order),
        })
    enters = F.struct(F.col(BATCH).alias("batch"), F.lit(1).alias("change"))
    leaves = F.struct(F.col("leaves").alias("batch"), F.lit(-1).alias("change"))
    moves = flow.select(KEY, "pos", AT, "cells", F.inline(F.array(enters, leaves))).filter(
        F.col("batch").isNotNull()
    )
    entering = F.col("change") > 0
    change = [
        F.sum(F.when(F.col("bucket") == k, F.col("change")).otherwise(0)).alias(f"w{k}")
        for k in range(buckets)
    ]
    per_feature = (
        moves.select(KEY, F.col("batch").alias(BATCH), "change", "pos", AT, F.inline("cells"))
        .groupBy(KEY, "feature_pos", BATCH)
        .agg(
            *change,
            F.max(F.when(entering, F.col("pos"))).alias("seen"),
            F.max(F.when(entering, F.col(AT))).alias(AT),
        )
    )
    sums = {f"w{k}": ("sum", f"w{k}") for k in range(buckets)}
    # the evaluation clock of a monitor never runs backwards
    windows = running(
        per_feature, [KEY, "feature_pos"], BATCH, {**sums, AT: ("max", AT)}, edges=batch_edges
    )
    size = F.least(F.col("seen"), F.lit(options.window_size).cast("bigint"))
    expected = baselines.select(
        KEY, "feature_pos", "feature_name", "feature_type", "bucket_labels",
        F.col("expected_distribution").alias("baseline_distribution"),
    )
    scored = lookup_join(
        windows.filter(F.col(BATCH) != CARRIED).withColumn("window_rows", size),
        expected, [KEY, "feature_pos"], spread_by=[BATCH], at_most=known["rows"],
    )
    shares = [F.col(f"w{k}") / F.col("window_rows") for k in range(buckets)]
    scored = scored.withColumn(
        "psi", psi_of_columns(F.col("baseline_distribution"), shares)
    ).withColumn(
        "status", feature_status(F.col("psi"), options.warning_threshold, options.drift_threshold)
    )
    result = F.struct(
        (-F.col("psi")).alias("by_psi"), "feature_pos", "feature_name", "feature_type", "psi",
        "status", "bucket_labels", "baseline_distribution",
        F.slice(F.array(*shares), 1, F.size("baseline_distribution")).alias("observed_distribution"),
    )
    ready = F.col("window_rows") >= options.min_samples
    merged = scored.groupBy(KEY, BATCH).agg(
        F.max(AT).alias("evaluated_at"),
        F.max("window_rows").alias("window_rows"),
        F.count_if(F.col("status") == "drift").alias("drifted"),
        F.count_if(F.col("status") == "warning").alias("warned"),
        F.max("psi").alias("psi"),
        F.array_sort(F.collect_list(result)).alias("results"),
    )

    def named(*levels: str) -> Column:
        kept = F.filter("results", lambda r: r["status"].isin(*levels))
        return F.when(ready, F.transform(kept, lambda r: r["feature_name"]))

    return merged.select(
        KEY, BATCH, "evaluated_at", "window_rows", ready.alias("evaluated"),
        F.when(
            ready, overall_status(F.col("drifted"), F.col("warned"), options.min_drifted_features)
        ).alias("status"),
        F.when(ready, F.col("drifted")).alias("drifted_feature_count"),
        F.when(ready, F.col("warned")).alias("warning_feature_count"),
        F.when(ready, F.col("psi")).alias("max_feature_psi"),
        named("drift").alias("drifted_features"),
        named("drift", "warning").alias("alert_features"),
        F.when(
            ready, F.transform("results", lambda r: r.dropFields("by_psi", "feature_pos"))
        ).alias("feature_results"),
    )


def arrival_order(rows: DataFrame, carried: DataFrame | None = None, edges: Sequence[float] = ()) -> DataFrame:
    """Rows whose ``seq`` follows their arrival: by batch, then ``seq``, after all carried rows.

    Each batch of a monitor is moved behind its predecessors as a whole, so only
    one row per (monitor, batch) is ordered. A batch at or before the last
    carried one fails the query: it would change what was already evaluated.
    """
    spans = rows.groupBy(KEY, BATCH).agg(F.min(SEQ).alias("low"), (F.max(SEQ) - F.min(SEQ) + 1).alias("width"))
    if carried is None:
        spans = spans.withColumns({"last": F.lit(-1).cast("bigint"), "done": F.lit(None).cast("bigint")})
    else:
        before = carried.groupBy(KEY).agg(F.max(SEQ).alias("last"), F.max(BATCH).alias("done"))
        spans = spans.join(before, KEY, "left").withColumn("last", F.coalesce("last", F.lit(-1).cast("bigint")))
    moved = running(spans, [KEY], BATCH, {"upto": ("sum", "width")}, edges=edges)
    shift = F.col("last") + 1 + F.col("upto") - F.col("width") - F.col("low")
    late = F.raise_error(F.concat(F.lit("batch "), BATCH, F.lit(" of monitor "), KEY, F.lit(" goes back behind batch "), "done"))
    # the check is part of the number every later step needs
    checked = F.when(F.col("done") >= F.col(BATCH), late.cast("bigint")).otherwise(shift)
    shifts = moved.select(F.col(KEY).alias("__key"), F.col(BATCH).alias("__batch"), checked.alias("__shift"))
    return (rows.join(shifts, (F.col(KEY) == F.col("__key")) & (F.col(BATCH) == F.col("__batch")))
            .withColumn(SEQ, F.col(SEQ) + F.col("__shift")).drop("__key", "__batch", "__shift"))


def status_changes(evaluations: DataFrame, state: DataFrame | None = None,
                   edges: Sequence[float] | None = None) -> DataFrame:
    """Evaluated batches with the status before them; a monitor starts out stable."""
    edges = block_edges(evaluations, BATCH, keys=[KEY]) if edges is None else edges
    lagged = previous(
        evaluations.filter("evaluated"), [KEY], BATCH, "status", "previous_status", edges=edges
    )
    start = F.lit(INITIAL_STATUS)
    if state is not None:
        known = state.select(KEY, F.col("previous_status").alias("__before"))
        lagged = lookup_join(lagged, known, [KEY], "left", spread_by=[BATCH])
        start = F.coalesce(F.col("__before"), start)
    return (
        lagged.withColumn("previous_status", F.coalesce("previous_status", start))
        .withColumn("changed", F.col("status") != F.col("previous_status"))
        .drop("__before")
    )


def _chain_by_fold(sessions: DataFrame, cooldown: int) -> DataFrame:
    """Trigger times of sessions whose size has been checked."""

    def step(taken: Column, t: Column) -> Column:
        last = F.get(taken, F.size(taken) - 1)
        free = F.coalesce(t - last >= cooldown, F.lit(True))
        return F.when(free, F.concat(taken, F.array(t))).otherwise(taken)

    times = F.array_sort(F.collect_list("t"))
    none = F.array().cast("array<bigint>")
    return sessions.groupBy(KEY, "session").agg(F.aggregate(times, none, step).alias("taken")).select(
        KEY, F.explode("taken").alias("t")
    )


def _chain_by_doubling(sessions: DataFrame, cooldown: int, rows_per_block: int) -> DataFrame:
    """Trigger times of sessions of any size, by pointer doubling with equi-joins.

    Every time points to the first one a cooldown later; following 1, 2, 4, ...
    pointers at once reaches all triggers in a logarithmic number of rounds.
    """
    keys = [KEY, "session"]
    own = sessions.select(*keys, F.col("t").alias("x"), F.lit(1).alias("kind"),
                          F.col("t").alias("own"), F.lit(None).cast("bigint").alias("t"))
    probe = sessions.select(*keys, (F.col("t") + cooldown).alias("x"), F.lit(0).alias("kind"),
                            F.lit(None).cast("bigint").alias("own"), "t")
    found = running(
        own.unionByName(probe), keys, "x", {"next": ("min", "own")}, descending=True, ties=["kind"],
        edges=block_edges(sessions, "t", rows_per_block),
    )
    jump = found.filter((F.col("kind") == 0) & F.col("next").isNotNull()).select(*keys, "t", "next")
    jump = cut_lineage(jump)
    reached = sessions.groupBy(*keys).agg(F.min("t").alias("t"))
    while not jump.isEmpty():
        ahead = reached.join(jump, [*keys, "t"]).select(*keys, F.col("next").alias("t"))
        reached = cut_lineage(reached.unionByName(ahead))
        further = jump.select(*keys, F.col("t").alias("next"), F.col("next").alias("next2"))
        jump = cut_lineage(
            jump.join(further, [*keys, "next"]).select(*keys, "t", F.col("next2").alias("next"))
        )
    return reached.select(KEY, "t")


def _trigger_batches(
    attempts: DataFrame, cooldown: int, fold_limit: int, rows_per_block: int, at_most: int | None
) -> DataFrame:
    """(monitor, time) of the triggers among evaluations that would succeed.

    A pause of at least one cooldown makes the next evaluation a trigger whatever
    came before, so the chain splits into independent sessions there.
    """
    times = attempts.select(KEY, "t").distinct()
    edges = block_edges(times, "t", rows_per_block, at_most)
    lagged = previous(times, [KEY], "t", "t", "before", edges=edges)
    head = F.coalesce(F.col("t") - F.col("before") >= cooldown, F.lit(True)).cast("bigint")
    sessions = running(
        lagged.withColumn("head", head), [KEY], "t", {"session": ("sum", "head")}, edges=edges
    ).select(KEY, "session", "t")
    sessions = cut_lineage(sessions)
    large = sessions.groupBy(KEY, "session").count().filter(F.col("count") > fold_limit)
    large = large.select(KEY, "session")
    if large.isEmpty():
        return _chain_by_fold(sessions, cooldown)
    small = sessions.join(large, [KEY, "session"], "left_anti")
    hot = cut_lineage(sessions.join(large, [KEY, "session"], "left_semi"))
    return _chain_by_fold(small, cooldown).unionByName(
        _chain_by_doubling(hot, cooldown, rows_per_block)
    )


def retraining_decisions(
    changes: DataFrame,
    options: RetrainingOptions,
    state: DataFrame | None = None,
    outcome: Column | None = None,
    fold_limit: int = FOLD_LIMIT,
    rows_per_block: int = ROWS_PER_BLOCK,
    at_most: int | None = None,
) -> DataFrame:
    """Add the retraining decision to every evaluation.

    Only detected drift asks for retraining. A request is attempted when the
    last successful one is at least a cooldown ago; failed requests do not start
    a cooldown. ``outcome`` is the result an attempt gives (default: triggered);
    ``at_most`` is a number of a monitor's evaluations and states known not to be exceeded.
    """
    if not options.enabled:
        return changes.withColumns(
            {
                "attempted": F.lit(False),
                "triggered": F.lit(False),
                "trigger_status": F.lit(None).cast("string"),
                "write_event": F.col("changed"),
            }
        )
    cooldown = options.cooldown_minutes * 60_000_000
    # the backend and its configuration come before what a delivery would answer
    if options.backend == "disabled":
        result = F.lit("disabled")
    elif not options.workflow_id:
        result = F.lit(MISCONFIGURED)
    else:
        result = outcome if outcome is not None else F.lit(TRIGGERED)
    timed = changes.withColumns(
        {"t": F.unix_micros("evaluated_at"), "__outcome": result.cast("string")}
    )
    drifted = timed.filter(F.col("status") == DRIFTED)
    able = drifted.filter(F.col("__outcome") == TRIGGERED)
    known = None
    if state is not None:
        known = state.filter(F.col("last_triggered_at").isNotNull()).select(
            KEY, F.unix_micros("last_triggered_at").alias("__started")
        )
    if cooldown == 0:
        taken = able.select(KEY, BATCH)
    else:
        attempts = able.select(KEY, "t")
        if known is not None:
            attempts = attempts.unionByName(known.select(KEY, F.col("__started").alias("t")))
        triggers = _trigger_batches(attempts, cooldown, fold_limit, rows_per_block, at_most)
        firsts = able.groupBy(KEY, "t").agg(F.min(BATCH).alias(BATCH))
        taken = firsts.join(triggers, [KEY, "t"]).select(KEY, BATCH)
        if known is not None:
            # a cooldown that runs since before also covers the instant it started
            taken = (
                taken.join(firsts, [KEY, BATCH])
                .join(known, [KEY], "left")
                .filter(F.col("__started").isNull() | (F.col("t") > F.col("__started")))
                .select(KEY, BATCH)
            )
    marked = drifted.select(KEY, BATCH, "t").join(
        taken.withColumn("__hit", F.lit(True)), [KEY, BATCH], "left"
    )
    started = running(
        marked.withColumn("__at", F.when(F.col("__hit"), F.col("t"))), [KEY], BATCH,
        {"__last": ("max", "__at")}, inclusive=False,
        edges=block_edges(marked, BATCH, rows_per_block, at_most),
    ).select(KEY, BATCH, "__last")
    joined = timed.join(started, [KEY, BATCH], "left")
    last = F.col("__last")
    if known is not None:
        joined = lookup_join(joined, known, [KEY], "left", spread_by=[BATCH])
        last = F.coalesce(last, F.col("__started"))
    is_drift = F.col("status") == DRIFTED
    free = F.coalesce(F.col("t") - last >= cooldown, F.lit(True))
    # a disabled backend answers without an attempt
    attempted = is_drift & free & (F.col("__outcome") != "disabled")
    return joined.withColumns(
        {
            "attempted": attempted,
            "triggered": attempted & (F.col("__outcome") == TRIGGERED),
            "trigger_status": F.when(is_drift, F.when(free, F.col("__outcome")).otherwise(COOLDOWN)),
        }
    ).withColumn("write_event", F.col("changed") | F.col("attempted")).drop(
        "t", "__outcome", "__last", "__started"
    )


def decide(
    evaluations: DataFrame,
    retraining: RetrainingOptions,
    state: DataFrame | None = None,
    outcome: Column | None = None,
    stored: bool = False,
    **limits: int,
) -> DataFrame:
    """Status changes and retraining decisions; evaluations are materialized once.

    ``stored`` says that they are already; ``at_most`` is a number of a monitor's
    evaluations and states known not to be exceeded.
    """
    kept = evaluations if stored else cut_lineage(evaluations)
    rows_per_block = limits.get("rows_per_block", ROWS_PER_BLOCK)
    edges = block_edges(kept, BATCH, rows_per_block, limits.get("at_most"), [KEY])
    if not edges and state is None:  # what follows only has fewer rows
        limits["at_most"] = rows_per_block
    changes = status_changes(kept, state, edges)
    decided = retraining_decisions(changes, retraining, state, outcome, **limits)
    return decided.withColumn(
        "event_id", F.when(F.col("write_event"), event_id("evaluated_at", "status"))
    )


def drift_events(
    decisions: DataFrame,
    options: DriftOptions,
    retraining: RetrainingOptions,
    models: DataFrame | None = None,
) -> DataFrame:
    """One event per status change or attempted retraining, with its JSON payload.

    Decisions that carry a ``delivery`` (``outbox``) pass on what it answered.
    """
    events = decisions.filter("write_event")
    reference = ("model_name", "source_type", "source_uri", "training_run_id",
                 "registered_model_name", "registered_model_version")
    if models is None:
        events = events.withColumns({c: F.lit(None).cast("string") for c in reference})
    else:
        events = lookup_join(events, models.select(KEY, *reference), [KEY], "left", spread_by=[BATCH])
    at = F.date_format("evaluated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    answered = "delivery" in decisions.columns
    sent = F.col("attempted") & (F.col("trigger_status") != MISCONFIGURED)

    def answer(field: str, kind: str) -> Column:
        return F.when(sent, F.col(f"delivery.{field}")) if answered else F.lit(None).cast(kind)

    trigger = F.struct(
        "attempted", "triggered", F.col("trigger_status").alias("status"),
        F.lit(retraining.backend).alias("backend"), F.lit(retraining.workflow_id).alias("workflow_id"),
        F.when(sent, request_run_id()).alias("run_id"),
        answer("request_url", "string").alias("request_url"),
        answer("status_code", "int").alias("response_status_code"),
        F.when(F.col("trigger_status") == MISCONFIGURED, "no workflow is configured")
        .otherwise(answer("detail", "string")).alias("detail"),
    )
    payload = F.struct(
        "event_id",
        at.alias("created_at_utc"),
        KEY,
        F.struct(*reference).alias("model"),
        F.struct(
            F.lit(options.warning_threshold).alias("warning_threshold"),
            F.lit(options.drift_threshold).alias("drift_threshold"),
            F.lit(options.min_drifted_features).alias("min_drifted_features"),
            F.lit(options.window_size).alias("window_size"),
            F.lit(options.min_samples).alias("min_samples"),
        ).alias("thresholds"),
        F.struct(
            "status", F.col("window_rows").alias("observed_sample_size"), "drifted_feature_count",
            "warning_feature_count", "max_feature_psi", "feature_results",
            at.alias("evaluated_at_utc"),
            F.lit(options.min_samples).alias("min_samples"),
            F.lit(options.window_size).alias("window_size"),
            F.lit(options.warning_threshold).alias("warning_threshold"),
            F.lit(options.drift_threshold).alias("drift_threshold"),
        ).alias("evaluation"),
        F.when(F.col("trigger_status").isNotNull(), trigger).alias("retraining_trigger"),
    )
    return events.select(
        KEY, BATCH, "event_id", "evaluated_at", "status", "previous_status", "trigger_status",
        "drifted_features", "alert_features", "max_feature_psi",
        F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"),
    )


def request_run_id() -> Column:
    return F.concat(F.lit("drift__"), stamp("evaluated_at"))


def retraining_requests(
    decisions: DataFrame, retraining: RetrainingOptions, models: DataFrame | None = None
) -> DataFrame:
    """One request row per attempted retraining, under a key that is the same whenever it is decided."""
    asked = decisions.filter("attempted")
    reference = ("source_type", "training_run_id", "registered_model_name", "registered_model_version")
    if models is None:
        asked = asked.withColumns({c: F.lit(None).cast("string") for c in reference})
    else:
        asked = lookup_join(asked, models.select(KEY, *reference), [KEY], "left", spread_by=[BATCH])
    conf = F.struct(
        "event_id", KEY, F.lit("drift_monitor").alias("trigger_source"),
        F.col("source_type").alias("model_source"), "training_run_id", "registered_model_name",
        "registered_model_version", F.col("status").alias("drift_status"),
        F.col("window_rows").alias("observed_sample_size"), "drifted_features", "max_feature_psi",
    )
    return asked.select(
        KEY, BATCH,
        F.sha2(F.concat_ws("|", KEY, "event_id"), 256).alias("request_key"),
        request_run_id().alias("request_run_id"),
        F.lit(retraining.workflow_id).alias("workflow_id"),
        F.col("trigger_status").alias("outcome"),
        F.to_json(conf, {"ignoreNullFields": "false"}).alias("conf"),
    )


def monitor_states(
    evaluations: DataFrame, decisions: DataFrame, state: DataFrame | None = None, models: DataFrame | None = None
) -> DataFrame:
    """State of every monitor after its last batch, carried on from an earlier state.

    ``models`` names what a monitor watches; its ``source_type`` is the state's ``model_source``.
    """
    rows = evaluations.groupBy(KEY).agg(
        F.max_by("window_rows", BATCH).alias("current_window_rows")
    )
    seen = decisions.groupBy(KEY).agg(
        F.max_by("status", BATCH).alias("previous_status"),
        F.max("evaluated_at").alias("last_evaluated_at"),
        F.max_by("event_id", F.when(F.col("write_event"), F.col(BATCH))).alias("last_event_id"),
        F.max(F.when(F.col("triggered"), F.col("evaluated_at"))).alias("last_triggered_at"),
        F.max_by("event_id", F.when(F.col("triggered"), F.col(BATCH))).alias("last_triggered_event_id"),
    )
    fresh = rows.join(seen, [KEY], "left")
    if models is None:
        fresh = fresh.withColumn("model_source", F.lit(None).cast("string"))
    else:
        fresh = fresh.join(models.select(KEY, F.col("source_type").alias("model_source")), [KEY], "left")
    fields = [f.split()[0] for f in STATE_SCHEMA.split(", ")][1:]
    if state is None:
        merged = fresh
    else:
        old = state.select(KEY, *[F.col(f).alias(f"__{f}") for f in fields if f in state.columns])
        merged = fresh.join(old, [KEY], "full").withColumns(
            {f: F.coalesce(F.col(f), F.col(f"__{f}")) for f in fields if f in state.columns}
        )
    return merged.withColumn(
        "previous_status", F.coalesce("previous_status", F.lit(INITIAL_STATUS))
    ).select(KEY, *fields)
