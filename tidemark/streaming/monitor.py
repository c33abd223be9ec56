"""The drift monitor on a stream of observations.

Each micro-batch runs the batch operators on the new rows plus the windows and
states of the monitors that have any. Windows and states are a log of versions
(see ``sources/commit_log``): only buckets with touched monitors are read and
written. Events, requests and decisions are written below ``micro_batch=<id>``
folders. All of it becomes visible with the commit of the micro-batch, so a
replay before it overwrites and one after it changes nothing.

Rows count in the order they arrive: by micro-batch, then batch, then ``seq``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.monitor import (
    AT,
    BATCH,
    KEY,
    SEQ,
    arrival_order,
    decide,
    drift_events,
    evaluate_history,
    monitor_states,
    retraining_requests,
    rolling_window,
)
from tidemark.options import DriftOptions, FeatureSpec, RetrainingOptions
from tidemark.plans.lookup import lookup_join
from tidemark.plans.ordered import ROWS_PER_BLOCK, block_edges
from tidemark.session import checkpoints_removed, cut_lineage
from tidemark.sources.commit_log import BUCKETS, COMPACT_AFTER, CommitLog
from tidemark.sources.store import partition_path, read_if_present

PART = "micro_batch"
LOGGED = ("window", "state")


@dataclass(frozen=True)
class MonitorStream:
    """What a monitoring stream needs to know; ``on_decision`` receives the decisions
    of each micro-batch and its id, for delivery to other systems. It is called
    again when a committed micro-batch is replayed."""

    root: str
    baselines: DataFrame
    spec: FeatureSpec
    options: DriftOptions
    retraining: RetrainingOptions
    models: DataFrame | None = None
    outcome: Column | None = None
    on_decision: Callable[[DataFrame, int], None] | None = None
    rows_per_block: int = ROWS_PER_BLOCK
    buckets: int = BUCKETS
    compact_after: int = COMPACT_AFTER

    @cached_property
    def _known(self) -> tuple[DataFrame, int]:
        known = self.baselines.select(KEY).distinct()
        return known, known.count()

    def log(self, spark: SparkSession) -> CommitLog:
        return CommitLog(spark, self.root, KEY, self.buckets, self.compact_after)

    def _path(self, table: str, batch: int) -> str:
        return partition_path(self.root, table, PART, batch)

    def _write(self, table: str, batch: int, df: DataFrame) -> DataFrame:
        path = self._path(table, batch)
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def process(self, rows: DataFrame, batch: int) -> None:
        """Handle one micro-batch; also callable by hand on a batch table."""
        spark = rows.sparkSession
        log = self.log(spark)
        newest = log.newest()
        if newest is not None and newest >= batch:
            decisions = read_if_present(spark, self._path("decisions", batch))
        elif batch > 0 and newest != batch - 1:
            raise FileNotFoundError(
                f"micro-batch {batch - 1} has no commit below {self.root}; monitors cannot go on without it")
        else:
            with checkpoints_removed(spark):
                decisions = self._advance(log, rows, batch, {} if newest is None else log.live(newest))
        if self.on_decision is not None and decisions is not None:
            self.on_decision(decisions, batch)

    def _advance(self, log: CommitLog, rows: DataFrame, batch: int, live) -> DataFrame:
        known, monitors = self._known
        names = [KEY, BATCH, SEQ, AT, *[c for c in self.spec.all if c in rows.columns]]
        fresh = lookup_join(rows.select(*names), known, [KEY], "left_semi", at_most=monitors).persist()
        try:
            # one row per touched monitor
            touched = cut_lineage(fresh.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")))
            seen = touched.agg(F.collect_set(log.bucket()).alias("buckets"), F.max("n").alias("most"),
                               F.count("n").alias("monitors")).first()
            buckets, count, rows_most = seen["buckets"], seen["monitors"], seen["most"] or 0
            window, state = (log.read(table, live, buckets) for table in LOGGED)
            if state is not None:
                state = lookup_join(state, touched.select(KEY), [KEY], "left_semi", at_most=count)
                window = lookup_join(window, touched.select(KEY), [KEY], "left_semi", at_most=count)
            most = rows_most + (self.options.window_size if window is not None else 0)
            ordered = cut_lineage(arrival_order(
                fresh, window, block_edges(fresh, BATCH, self.rows_per_block, rows_most, [KEY])))
            found = cut_lineage(
                evaluate_history(
                    ordered, self.baselines, self.spec, self.options, window, self.rows_per_block, most
                )
            )
            decisions = self._write(
                "decisions", batch,
                decide(found, self.retraining, state, self.outcome, stored=True,
                       rows_per_block=self.rows_per_block, at_most=rows_most + 1),
            )
            self._write(
                "events", batch, drift_events(decisions, self.options, self.retraining, self.models)
            )
            self._write("requests", batch, retraining_requests(decisions, self.retraining, self.models))
            rows_now = ordered if window is None else ordered.unionByName(window)
            changed = log.write("state", batch, monitor_states(found, decisions, state, self.models), live, buckets)
            changed |= log.write("window", batch, rolling_window(rows_now, self.options.window_size), live, buckets)
            log.commit(batch, {**live, **changed})
        finally:
            fresh.unpersist()
        return decisions

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def latest(self, spark: SparkSession, table: str = "state") -> DataFrame | None:
        """States or window rows of all monitors as of the newest commit."""
        log = self.log(spark)
        newest = log.newest()
        return None if newest is None else log.read(table, log.live(newest))


def read_monitor_table(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """Events, requests or decisions of all committed micro-batches."""
    newest = CommitLog(spark, root, KEY).newest()
    found = None if newest is None else read_if_present(spark, f"{root.rstrip('/')}/{table}")
    return None if found is None else found.withColumn(PART, F.col(PART).cast("bigint")).filter(F.col(PART) <= newest)
