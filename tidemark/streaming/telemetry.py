"""Telemetry rates on a stream of log rows.

Rows are counted per step first; ranges are made of step counts, so a row is
counted once however many ranges hold it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.columns import col
from tidemark.operators.telemetry import RATE_RANGE_SECONDS, RATE_STEP_SECONDS, rate_of_steps
from tidemark.sources.store import partition_path

MICRO_BATCH = "micro_batch"


def stream_step_counts(
    stream: DataFrame,
    by: Sequence[str],
    ts: str = "ts",
    lateness: str = "10 minutes",
    step_seconds: int = RATE_STEP_SECONDS,
) -> DataFrame:
    """Rows per step; the state holds the steps the watermark has not closed."""
    return (
        stream.withColumn("__ts", col(ts).cast("timestamp"))
        .withWatermark("__ts", lateness)
        .groupBy(F.window("__ts", f"{step_seconds} seconds").alias("__step"), *[col(c) for c in by])
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def stream_rate(
    stream: DataFrame,
    by: Sequence[str],
    ts: str = "ts",
    lateness: str = "10 minutes",
    range_seconds: int = RATE_RANGE_SECONDS,
    step_seconds: int = RATE_STEP_SECONDS,
) -> DataFrame:
    """Events per second over sliding event-time ranges, for append output.

    Two stateful aggregations in a chain: closed steps, then ranges of them. A
    range comes out once the watermark has passed its end; rows later than
    ``lateness`` are left out once their step is closed.
    """
    if range_seconds % step_seconds:
        raise ValueError("the range must be a whole number of steps")
    per_step = stream_step_counts(stream, by, ts, lateness, step_seconds)
    sliding = F.window(F.window_time("__step"), f"{range_seconds} seconds", f"{step_seconds} seconds")
    return (
        per_step.groupBy(sliding.alias("__range"), *[col(c) for c in by])
        .agg(F.sum("row_count").alias("__n"))
        .select(
            F.col("__range.start").alias("window_start"), *by,
            (F.col("__n") / F.lit(float(range_seconds))).alias("rate"),
        )
    )


def _per_micro_batch(rows: DataFrame, mode: str, path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(partition_path(path, "", MICRO_BATCH, batch))

    return (
        rows.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def write_steps(steps: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the steps that a micro-batch has changed, one folder per micro-batch,
    so a replayed micro-batch replaces its own rows. ``current_rate`` reads them."""
    return _per_micro_batch(
        steps.select(F.col("__step.start").alias("step_start"), *[c for c in steps.columns if c != "__step"]),
        "update", path, checkpoint, trigger,
    )


def current_rate(
    spark: SparkSession,
    path: str,
    by: Sequence[str],
    range_seconds: int = RATE_RANGE_SECONDS,
    step_seconds: int = RATE_STEP_SECONDS,
) -> DataFrame:
    """Rates of all ranges so far, open ones included: of a step the newest count is right."""
    newest = spark.read.parquet(path).groupBy("step_start", *[col(c) for c in by]).agg(
        F.max_by("row_count", MICRO_BATCH).alias("row_count"))
    return rate_of_steps(newest, by, range_seconds, step_seconds)


def write_closed(rates: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append ranges once the watermark has closed them, one folder per micro-batch,
    so a replayed micro-batch replaces its own rows."""
    return _per_micro_batch(rates, "append", path, checkpoint, trigger)
