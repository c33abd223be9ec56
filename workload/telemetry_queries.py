"""Counters, histograms, quantiles and rates over logs derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import telemetry as tm
from tidemark.session import new_folder
from tidemark.streaming.telemetry import current_rate, stream_rate, stream_step_counts, write_closed, write_steps
from workload import query, table


def request_log(spark, sf):
    """Events as requests: the type is the route, the JSON counter decides the status."""
    ev = table(spark, sf, "events")
    return request_rows(ev)


def request_rows(ev):
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return ev.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind.isin("view", "click"), "get").otherwise("Post").alias("method"),
        F.when(kind == "signup", "/metrics").when(kind == "error", "")
        .otherwise(F.concat(F.lit("/v1/"), kind)).alias("route"),
        F.when(k < 80, 200).when(k < 92, 404).otherwise(503).alias("status_code"),
        (F.col("value") / 100).alias("duration_s"),
    )


_REQUESTS = """
    WITH raw AS (SELECT ts, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
    log AS (SELECT ts, CASE WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'POST' END AS method,
                   CASE WHEN event_type = 'error' THEN '/unmatched' ELSE '/v1/' || event_type END AS route,
                   CASE WHEN k < 80 THEN 200 WHEN k < 92 THEN 404 ELSE 503 END AS status, value / 100 AS d
            FROM raw WHERE event_type <> 'signup')
"""


def edges_values(edges) -> str:
    """FROM item with the finite edges and the open last one."""
    rows = ", ".join(f"('{float(e)!r}', CAST({e!r} AS DOUBLE))" for e in edges)
    return f"(VALUES {rows}, ('+Inf', CAST('inf' AS DOUBLE))) e(le, upper)"


@query(
    "request_counts",
    _REQUESTS + """SELECT method, route, CAST(status AS VARCHAR) AS status_code, count(*) AS requests
                   FROM log GROUP BY ALL""",
)
def request_counts(spark, sf):
    return tm.request_counts(request_log(spark, sf))


@query(
    "failures",
    _REQUESTS + """SELECT method, route, CASE WHEN status < 500 THEN 'client_error' ELSE 'server_error' END
                   AS status_family, count(*) AS failures FROM log WHERE status >= 400 GROUP BY ALL""",
)
def failures(spark, sf):
    return tm.failure_counts(request_log(spark, sf))


@query(
    "model_loads",
    """
    SELECT 'nation_' || s_nationkey AS model_source, CASE WHEN s_acctbal >= 0 THEN 'success' ELSE 'failure' END AS result,
           count(*) AS loads FROM supplier GROUP BY ALL
    """,
)
def model_loads(spark, sf):
    log = table(spark, sf, "supplier").select(
        F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("model_source"),
        F.when(F.col("s_acctbal") >= 0, "success").otherwise("failure").alias("result"),
    )
    return tm.model_loads(log)


@query(
    "latency_histogram",
    _REQUESTS
    + f"""SELECT method, route, le, upper, count(*) FILTER (d <= upper) AS bucket_count, count(*) AS value_count,
                 round(sum(d), 6) AS value_sum FROM log CROSS JOIN {edges_values(tm.LATENCY_EDGES)} GROUP BY ALL""",
)
def latency_histogram(spark, sf):
    return tm.latency_histogram(request_log(spark, sf)).withColumn("value_sum", F.round("value_sum", 6))


_QUANTILE = """
    , q AS (SELECT *, 0.95::DOUBLE * max(c) OVER (PARTITION BY {by}) AS wanted,
                   coalesce(lag(upper) OVER (PARTITION BY {by} ORDER BY upper), 0) AS lower,
                   coalesce(lag(c) OVER (PARTITION BY {by} ORDER BY upper), 0) AS below FROM b)
    SELECT {by}, round(CASE WHEN le = '+Inf' THEN lower ELSE lower + (upper - lower) * ((wanted - below) / (c - below)) END, 6)
           AS quantile
    FROM q WHERE c >= wanted AND wanted > 0 QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY upper) = 1
"""


@query(
    "latency_p95",
    _REQUESTS
    + f""", b AS (SELECT route, le, upper, count(*) FILTER (d <= upper) AS c
                  FROM log CROSS JOIN {edges_values(tm.LATENCY_EDGES)} GROUP BY ALL)"""
    + _QUANTILE.format(by="route"),
)
def latency_p95(spark, sf):
    return tm.latency_quantile(request_log(spark, sf)).withColumn("quantile", F.round("quantile", 6))


# every row belongs to the five one-minute starts whose five minutes contain it
_WINDOWS = "(SELECT unnest(range(0, 5)) AS back) w"
_START = "time_bucket(INTERVAL 1 MINUTE, ts) - back * INTERVAL 1 MINUTE"


def _stamped(df):
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def _rated(df):
    return _stamped(df).withColumn("rate", F.round("rate", 9))


_START_TEXT = f"strftime({_START}, '%Y-%m-%d %H:%M:%S') AS window_start"


@query(
    "latency_p95_windows",
    _REQUESTS
    + f""", b AS (SELECT {_START_TEXT}, route, le, upper, count(*) FILTER (d <= upper) AS c
                  FROM log CROSS JOIN {_WINDOWS} CROSS JOIN {edges_values(tm.LATENCY_EDGES)} GROUP BY ALL)"""
    + _QUANTILE.format(by="window_start, route"),
)
def latency_p95_windows(spark, sf):
    found = tm.latency_quantile_over_time(request_log(spark, sf))
    return _stamped(found).withColumn("quantile", F.round("quantile", 6))


@query(
    "request_rate",
    _REQUESTS
    + f"SELECT {_START_TEXT}, route, round(count(*) / 300, 9) AS rate FROM log CROSS JOIN {_WINDOWS} GROUP BY ALL",
)
def request_rate(spark, sf):
    return _rated(tm.request_rate(request_log(spark, sf)))


@query(
    "failure_rate",
    _REQUESTS
    + f"""SELECT {_START_TEXT}, route, CASE WHEN status < 500 THEN 'client_error' ELSE 'server_error' END AS status_family,
                 round(count(*) / 300, 9) AS rate FROM log CROSS JOIN {_WINDOWS} WHERE status >= 400 GROUP BY ALL""",
)
def failure_rate(spark, sf):
    return _rated(tm.failure_rate(request_log(spark, sf)))


def prediction_log(spark, sf):
    """Orders as predictions: a customer is one request, the price gives the probability."""
    o = table(spark, sf, "orders")
    p = F.least(F.col("o_totalprice") / 480000, F.lit(1.0))
    return o.select(
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_custkey").alias("request_id"),
        F.concat(F.lit("source_"), (F.col("o_custkey") % 3).cast("string")).alias("model_source"),
        (p >= 0.5).cast("int").alias("predicted_class"),
        (p >= 0.5).alias("predicted_positive"),
        F.when(F.col("o_orderstatus") != "P", p).alias("probability"),
    )


_PREDICTIONS = """
    WITH log AS (SELECT o_orderdate AS ts, o_custkey AS request_id, 'source_' || (o_custkey % 3) AS model_source,
                   least(o_totalprice / 480000, 1) AS p0, o_orderstatus FROM orders),
    pred AS (SELECT ts, request_id, model_source, CAST(p0 >= 0.5::DOUBLE AS INT) AS cls,
                    CASE WHEN o_orderstatus <> 'P' THEN p0 END AS probability FROM log),
    req AS (SELECT model_source, request_id, min(ts) AS ts, count(*) AS n FROM pred GROUP BY 1, 2)
"""


@query(
    "prediction_counts",
    _PREDICTIONS
    + """SELECT model_source, CAST(cls AS VARCHAR) AS predicted_class,
                CASE WHEN cls = 1 THEN 'true' ELSE 'false' END AS predicted_positive, count(*) AS records
         FROM pred GROUP BY ALL""",
)
def prediction_counts(spark, sf):
    return tm.prediction_record_counts(prediction_log(spark, sf))


@query(
    "prediction_request_counts",
    _PREDICTIONS + "SELECT model_source, count(*) AS requests FROM req GROUP BY 1",
)
def prediction_request_counts(spark, sf):
    return tm.prediction_request_counts(prediction_log(spark, sf))


def _histogram_sql(source: str, value: str, edges) -> str:
    return (
        _PREDICTIONS
        + f"""SELECT model_source, le, upper, count(*) FILTER ({value} <= upper) AS bucket_count, count(*) AS value_count,
                     round(CAST(sum({value}) AS DOUBLE), 6) AS value_sum
              FROM {source} CROSS JOIN {edges_values(edges)} WHERE {value} IS NOT NULL GROUP BY ALL"""
    )


@query("batch_histogram", _histogram_sql("req", "n", tm.BATCH_SIZE_EDGES))
def batch_histogram(spark, sf):
    return tm.batch_size_histogram(prediction_log(spark, sf)).withColumn(
        "value_sum", F.round("value_sum", 6)
    )


@query("probability_histogram", _histogram_sql("pred", "probability", tm.PROBABILITY_EDGES))
def probability_histogram(spark, sf):
    return tm.probability_histogram(prediction_log(spark, sf)).withColumn(
        "value_sum", F.round("value_sum", 6)
    )


@query(
    "prediction_rate",
    _PREDICTIONS
    + f"SELECT {_START_TEXT}, model_source, round(count(*) / 300, 9) AS rate FROM req CROSS JOIN {_WINDOWS} GROUP BY ALL",
)
def prediction_rate(spark, sf):
    return _rated(tm.prediction_request_rate(prediction_log(spark, sf)))


@query(
    "output_mix_rate",
    _PREDICTIONS
    + f"""SELECT {_START_TEXT}, CASE WHEN cls = 1 THEN 'true' ELSE 'false' END AS predicted_positive,
                 round(count(*) / 300, 9) AS rate FROM pred CROSS JOIN {_WINDOWS} GROUP BY ALL""",
)
def output_mix_rate(spark, sf):
    return _rated(tm.output_mix_rate(prediction_log(spark, sf)))


@query(
    "probability_rate",
    _PREDICTIONS
    + f"""SELECT {_START_TEXT}, le, round(count(*) FILTER (probability <= upper) / 300, 9) AS rate
          FROM pred CROSS JOIN {_WINDOWS} CROSS JOIN {edges_values(tm.PROBABILITY_EDGES)}
          WHERE probability IS NOT NULL GROUP BY ALL""",
)
def probability_rate(spark, sf):
    return _rated(tm.probability_rate(prediction_log(spark, sf)))


def _event_stream(spark, sf):
    ev = table(spark, sf, "events")
    files = spark.readStream.schema(ev.schema).parquet(f"{sf}/events*.parquet")
    return tm.labelled_requests(request_rows(files))


@query(
    "request_rate_stream",
    _REQUESTS
    + f"SELECT {_START_TEXT}, route, round(count(*) / 300, 9) AS rate FROM log CROSS JOIN {_WINDOWS} GROUP BY ALL",
)
def request_rate_stream(spark, sf):
    path = new_folder(spark, "rates")
    steps = stream_step_counts(_event_stream(spark, sf), ["route"])
    write_steps(steps, path, new_folder(spark, "rates-checkpoint")).awaitTermination()
    return _rated(current_rate(spark, path, ["route"]))


@query(
    "request_rate_stream_closed",
    _REQUESTS
    + f""", x AS (SELECT {_START} AS start, route, round(count(*) / 300, 9) AS rate
                  FROM log CROSS JOIN {_WINDOWS} GROUP BY ALL)
          SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, route, rate FROM x
          WHERE start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM log) - INTERVAL 10 MINUTE""",
)
def request_rate_stream_closed(spark, sf):
    path = new_folder(spark, "rates")
    rates = stream_rate(_event_stream(spark, sf), ["route"])
    write_closed(rates, path, new_folder(spark, "rates-checkpoint")).awaitTermination()
    return _rated(spark.read.parquet(path).drop("micro_batch"))
