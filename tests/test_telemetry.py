from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import telemetry as tm
from tidemark.session import new_folder
from tidemark.streaming.telemetry import current_rate, stream_rate, stream_step_counts, write_closed, write_steps

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
LOG = "ts timestamp, method string, route string, status_code int, duration_s double"
PREDICTIONS = (
    "ts timestamp, request_id string, model_source string, predicted_class int, "
    "predicted_positive boolean, probability double"
)


def test_one_request(spark):
    log = spark.createDataFrame([(START, "get", "/health", 200, 0.02), (START, "GET", "/metrics", 200, 1.0)], LOG)
    assert [tuple(r) for r in tm.request_counts(log).collect()] == [("GET", "/health", "200", 1)]
    assert tm.failure_counts(log).count() == 0
    buckets = {r["le"]: r["bucket_count"] for r in tm.latency_histogram(log).collect()}
    assert len(buckets) == 12 and buckets["0.01"] == 0 and buckets["0.025"] == 1 and buckets["+Inf"] == 1


def test_failures_by_family(spark):
    log = spark.createDataFrame(
        [(START, "post", "", 404, 0.1), (START, "post", None, 503, 0.1), (START, "post", "/x", 399, 0.1)], LOG
    )
    found = sorted(tuple(r) for r in tm.failure_counts(log).collect())
    assert found == [("POST", "/unmatched", "client_error", 1), ("POST", "/unmatched", "server_error", 1)]


def test_batch_of_two(spark):
    log = spark.createDataFrame(
        [(START, "r1", "run", 1, True, 0.7), (START, "r1", "run", 0, False, None)], PREDICTIONS
    )
    assert tm.prediction_request_counts(log).first()["requests"] == 1
    sizes = tm.batch_size_histogram(log).collect()
    assert {(r["value_count"], r["value_sum"]) for r in sizes} == {(1, 2.0)}
    assert {r["le"]: r["bucket_count"] for r in sizes}["1.0"] == 0
    scores = {r["le"]: r["bucket_count"] for r in tm.probability_histogram(log).collect()}
    assert scores["0.6"] == 0 and scores["0.7"] == 1 and scores["+Inf"] == 1
    mix = {r["predicted_positive"]: r["records"] for r in tm.prediction_record_counts(log).collect()}
    assert mix == {"true": 1, "false": 1}


def test_quantile_interpolates_and_stops_at_the_last_edge(spark):
    log = spark.createDataFrame(
        [(START, "get", "/a", 200, 0.2)] * 10 + [(START, "get", "/b", 200, 99.0)] * 3, LOG
    )
    found = {r["route"]: r["quantile"] for r in tm.latency_quantile(log).collect()}
    assert found["/a"] == pytest.approx(0.1 + 0.15 * 0.95) and found["/b"] == 10.0


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        (START + timedelta(seconds=37 * i % 4000), "get", f"/r{i % 2}", 200, 0.1) for i in range(400)
    ]
    return spark.createDataFrame(rows, LOG).cache()


def test_rate_counts_rows_in_every_range(log):
    want = (
        log.groupBy(F.window("ts", "300 seconds", "60 seconds").alias("w"), "route").count()
        .select("w.start", "route", (F.col("count") / 300.0).alias("rate"))
    )
    assert sorted(tm.request_rate(log).collect()) == sorted(want.collect())
    with pytest.raises(ValueError, match="whole number"):
        tm.rate(log, ["route"], range_seconds=100, step_seconds=60)


def test_streamed_rates_equal_batch_rates(spark, log):
    source = new_folder(spark, "log")
    for low in range(0, 4000, 1000):
        bound = F.unix_timestamp("ts") - F.unix_timestamp(F.lit(START))
        log.filter((bound >= low) & (bound < low + 1000)).coalesce(1).write.mode("append").parquet(source)

    def stream():
        return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)

    batch = sorted(tm.request_rate(log).collect())
    path = new_folder(spark, "current")
    checkpoint = new_folder(spark, "cp")
    write_steps(stream_step_counts(stream(), ["route"]), path, checkpoint).awaitTermination()
    assert sorted(current_rate(spark, path, ["route"]).collect()) == batch
    # rows that arrive later change their steps only
    before = spark.read.parquet(path)
    held = before.count()
    log.filter((bound >= 3900) & (bound < 4000)).coalesce(1).write.mode("append").parquet(source)
    write_steps(stream_step_counts(stream(), ["route"]), path, checkpoint).awaitTermination()
    assert 0 < spark.read.parquet(path).count() - held <= 6
    late = log.unionByName(log.filter((bound >= 3900) & (bound < 4000)))
    batch = sorted(tm.request_rate(late).collect())
    assert sorted(current_rate(spark, path, ["route"]).collect()) == batch

    path = new_folder(spark, "closed")
    write_closed(stream_rate(stream(), ["route"]), path, new_folder(spark, "cp")).awaitTermination()
    newest = log.agg(F.max("ts")).first()[0]
    closed = [r for r in batch if r["window_start"] + timedelta(minutes=15) <= newest]
    assert sorted(spark.read.parquet(path).drop("micro_batch").collect()) == closed
