"""Counters, histograms and rates over request, prediction and model-load logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import (
    METRICS_ROUTE,
    col,
    method_label,
    route_label,
    status_family,
)

# --- fixed values -----------------------------------------------------------
LATENCY_EDGES = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
BATCH_SIZE_EDGES = (1.0, 2.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0)
PROBABILITY_EDGES = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0)
INFINITE = "+Inf"
RATE_RANGE_SECONDS = 300
RATE_STEP_SECONDS = 60
# ----------------------------------------------------------------------------


def labelled_requests(log: DataFrame) -> DataFrame:
    """Request log with normalized labels; scrapes of the metrics route are left out."""
    return log.withColumns(
        {
            "method": method_label("method"),
            "route": route_label("route"),
            "status_family": status_family("status_code"),
            "status_code": F.col("status_code").cast("string"),
        }
    ).filter(~F.col("route").startswith(METRICS_ROUTE))


def counts(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*[col(c) for c in by]).agg(F.count(F.lit(1)).alias(name))


def request_counts(log: DataFrame) -> DataFrame:
    return counts(labelled_requests(log), ["method", "route", "status_code"], "requests")


def failure_counts(log: DataFrame) -> DataFrame:
    failed = labelled_requests(log.filter(F.col("status_code") >= 400))
    return counts(failed, ["method", "route", "status_family"], "failures")


def model_loads(log: DataFrame) -> DataFrame:
    return counts(log, ["model_source", "result"], "loads")


def requests_of(predictions: DataFrame) -> DataFrame:
    """One row per prediction request: when it came and how many records it had."""
    return predictions.groupBy("model_source", "request_id").agg(
        F.min("ts").alias("ts"), F.count(F.lit(1)).alias("record_count")
    )


def prediction_request_counts(predictions: DataFrame) -> DataFrame:
    return counts(requests_of(predictions), ["model_source"], "requests")


def with_output_labels(predictions: DataFrame) -> DataFrame:
    return predictions.withColumns(
        {
            "predicted_class": F.col("predicted_class").cast("string"),
            "predicted_positive": F.lower(F.col("predicted_positive").cast("string")),
        }
    )


def prediction_record_counts(predictions: DataFrame) -> DataFrame:
    return counts(
        with_output_labels(predictions), ["model_source", "predicted_class", "predicted_positive"],
        "records",
    )


def _le_counts(value: Column, edges: Sequence[float]) -> list[Column]:
    """Rows at or below every edge, and all rows with a value."""
    return [
        *[F.count_if(value <= F.lit(e)).alias(f"__le{i}") for i, e in enumerate(edges)],
        F.count(value).alias(f"__le{len(edges)}"),
    ]


def _le_rows(edges: Sequence[float], value: Column | None = None) -> Column:
    """The per-edge columns as (le, upper, bucket_count) rows."""
    labels = [*[repr(float(e)) for e in edges], INFINITE]
    uppers = [*[float(e) for e in edges], float("inf")]
    return F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(label).alias("le"),
                    F.lit(upper).alias("upper"),
                    F.col(f"__le{i}").alias("bucket_count"),
                )
                for i, (label, upper) in enumerate(zip(labels, uppers))
            ]
        )
    )


def histogram(df: DataFrame, by: Sequence[str], value: str, edges: Sequence[float]) -> DataFrame:
    """Cumulative ``le`` buckets with the count and sum of the observations.

    All edges are counted in one aggregation; null values are not observations.
    """
    counted = df.filter(col(value).isNotNull()).groupBy(*[col(c) for c in by]).agg(
        *_le_counts(col(value), edges), F.sum(col(value).cast("double")).alias("value_sum")
    )
    return counted.select(
        *by, _le_rows(edges), F.col(f"__le{len(edges)}").alias("value_count"), "value_sum"
    )


def latency_histogram(log: DataFrame) -> DataFrame:
    return histogram(labelled_requests(log), ["method", "route"], "duration_s", LATENCY_EDGES)


def batch_size_histogram(predictions: DataFrame) -> DataFrame:
    return histogram(requests_of(predictions), ["model_source"], "record_count", BATCH_SIZE_EDGES)


def probability_histogram(predictions: DataFrame) -> DataFrame:
    return histogram(predictions, ["model_source"], "probability", PROBABILITY_EDGES)


def histogram_quantile(buckets: DataFrame, by: Sequence[str], share: float) -> DataFrame:
    """Quantile read from cumulative buckets, linear inside the bucket that reaches it.

    A quantile in the open last bucket is the highest finite edge. A group has
    one row per edge, so its window is small whatever the data.
    """
    order = Window.partitionBy(*by).orderBy("upper")
    total = F.max("bucket_count").over(Window.partitionBy(*by))
    placed = buckets.withColumns(
        {
            "__wanted": total * F.lit(share),
            "__lower": F.coalesce(F.lag("upper").over(order), F.lit(0.0)),
            "__below": F.coalesce(F.lag("bucket_count").over(order), F.lit(0).cast("bigint")),
        }
    )
    first = placed.filter((F.col("bucket_count") >= F.col("__wanted")) & (F.col("__wanted") > 0))
    inside = F.col("__lower") + (F.col("upper") - F.col("__lower")) * (
        (F.col("__wanted") - F.col("__below")) / (F.col("bucket_count") - F.col("__below"))
    )
    value = F.when(F.col("le") == INFINITE, F.col("__lower")).otherwise(inside)
    return first.groupBy(*by).agg(F.min_by(value, F.col("upper")).alias("quantile"))


def latency_quantile(log: DataFrame, share: float = 0.95) -> DataFrame:
    by_route = histogram(labelled_requests(log), ["route"], "duration_s", LATENCY_EDGES)
    return histogram_quantile(by_route, ["route"], share)


def _slide(
    df: DataFrame,
    by: Sequence[str],
    sums: Sequence[Column],
    ts: str,
    range_seconds: int,
    step_seconds: int,
) -> DataFrame:
    """Sums per step first, then over sliding ranges of whole steps.

    Only the per-step sums are repeated for the ranges that contain them, not
    the log rows.
    """
    _check_range(range_seconds, step_seconds)
    labels = [col(c) for c in by]
    step = F.window(col(ts), f"{step_seconds} seconds")
    per_step = df.groupBy(step.alias("__step"), *labels).agg(*sums)
    names = [c for c in per_step.columns if c not in (*by, "__step")]
    return _ranges_of_steps(per_step, F.col("__step.start"), by, names, range_seconds, step_seconds)


def _check_range(range_seconds: int, step_seconds: int) -> None:
    if range_seconds % step_seconds:
        raise ValueError("the range must be a whole number of steps")


def _ranges_of_steps(
    per_step: DataFrame, start: Column, by: Sequence[str], names: Sequence[str], range_seconds: int, step_seconds: int
) -> DataFrame:
    sliding = F.window(start, f"{range_seconds} seconds", f"{step_seconds} seconds")
    return (
        per_step.groupBy(sliding.alias("__range"), *[col(c) for c in by])
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(F.col("__range.start").alias("window_start"), *by, *names)
    )


def rate_of_steps(
    steps: DataFrame,
    by: Sequence[str],
    range_seconds: int = RATE_RANGE_SECONDS,
    step_seconds: int = RATE_STEP_SECONDS,
) -> DataFrame:
    """Events per second over sliding ranges, from ``step_start, row_count`` per step."""
    _check_range(range_seconds, step_seconds)
    counted = _ranges_of_steps(steps, F.col("step_start"), by, ["row_count"], range_seconds, step_seconds)
    return counted.select("window_start", *by, (F.col("row_count") / F.lit(float(range_seconds))).alias("rate"))


def rate(
    df: DataFrame,
    by: Sequence[str],
    ts: str = "ts",
    range_seconds: int = RATE_RANGE_SECONDS,
    step_seconds: int = RATE_STEP_SECONDS,
) -> DataFrame:
    """Events per second over sliding ranges."""
    counted = _slide(df, by, [F.count(F.lit(1)).alias("__n")], ts, range_seconds, step_seconds)
    return counted.select(
        "window_start", *by, (F.col("__n") / F.lit(float(range_seconds))).alias("rate")
    )


def request_rate(log: DataFrame) -> DataFrame:
    return rate(labelled_requests(log), ["route"])


def failure_rate(log: DataFrame) -> DataFrame:
    return rate(
        labelled_requests(log.filter(F.col("status_code") >= 400)), ["route", "status_family"]
    )


def prediction_request_rate(predictions: DataFrame) -> DataFrame:
    return rate(requests_of(predictions), ["model_source"])


def output_mix_rate(predictions: DataFrame) -> DataFrame:
    return rate(with_output_labels(predictions), ["predicted_positive"])


def probability_rate(
    predictions: DataFrame,
    range_seconds: int = RATE_RANGE_SECONDS,
    step_seconds: int = RATE_STEP_SECONDS,
) -> DataFrame:
    """Rate of probability observations per cumulative bucket."""
    scored = predictions.filter(F.col("probability").isNotNull())
    sums = _le_counts(F.col("probability"), PROBABILITY_EDGES)
    slid = _slide(scored, [], sums, "ts", range_seconds, step_seconds)
    return slid.select("window_start", _le_rows(PROBABILITY_EDGES)).select(
        "window_start", "le", (F.col("bucket_count") / F.lit(float(range_seconds))).alias("rate")
    )


def latency_quantile_over_time(
    log: DataFrame,
    share: float = 0.95,
    range_seconds: int = RATE_RANGE_SECONDS,
    step_seconds: int = RATE_STEP_SECONDS,
) -> DataFrame:
    """Latency quantile per route in every sliding range."""
    sums = _le_counts(F.col("duration_s"), LATENCY_EDGES)
    slid = _slide(labelled_requests(log), ["route"], sums, "ts", range_seconds, step_seconds)
    buckets = slid.select("window_start", "route", _le_rows(LATENCY_EDGES))
    return histogram_quantile(buckets, ["window_start", "route"], share)
