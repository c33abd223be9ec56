"""Deliveries of retraining requests, folded into the decisions.

A request that was decided waits in the outbox under an idempotency key made of
its monitor and event. Whatever delivers it appends a row per attempt; the rows
may come late, twice and in any order. Decisions are then made again with what
the deliveries answered: a request that failed starts no cooldown, so the next
drift asks anew, under a key of its own.

Defined results: rows that repeat a key and an attempt count once, the earliest
answer first; the first successful attempt of a key is its result, the last
attempt if none succeeded. A request nobody has delivered yet is ``queued`` and
holds its cooldown. Deliveries without a key or for requests that were never
made are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import col, event_id
from tidemark.operators.monitor import BATCH, KEY, TRIGGERED, decide
from tidemark.options import RetrainingOptions
from tidemark.sources.store import partition_path, read_if_present

# --- fixed values -----------------------------------------------------------
HTTP_ERROR = "http_error"
REQUEST_ERROR = "request_error"
QUEUED = "queued"
# ----------------------------------------------------------------------------

DELIVERY_SCHEMA = (
    "request_key string, attempt int, delivered_at timestamp, request_url string, status_code int, detail string"
)


def request_key(event: str | Column = "event_id") -> Column:
    """Key under which a request may be sent any number of times and counts once."""
    return F.sha2(F.concat_ws("|", F.col(KEY), col(event)), 256)


def delivery_outcome(status_code: str | Column) -> Column:
    """Codes of 200 to 299 start a run; without a code nothing answered."""
    code = col(status_code)
    return F.when(code.isNull(), REQUEST_ERROR).when(code.between(200, 299), TRIGGERED).otherwise(HTTP_ERROR)


def delivery_results(deliveries: DataFrame) -> DataFrame:
    """``request_key`` and ``delivery``: the attempts made and the one that counts.

    One aggregation with partial results; no key's rows meet in a window.
    """
    good = F.coalesce(F.col("status_code").between(200, 299), F.lit(False))
    # the first success, else the last attempt, of its repeats the earliest
    rank = F.struct(
        good.alias("good"), F.when(good, -F.col("attempt")).otherwise(F.col("attempt")).alias("place"),
        (-F.unix_micros("delivered_at")).alias("early"),
    )
    answer = F.struct("attempt", "delivered_at", "request_url", "status_code", "detail")
    best = (
        deliveries.filter(F.col("request_key").isNotNull() & F.col("attempt").isNotNull())
        .groupBy("request_key")
        .agg(F.max(F.struct(rank.alias("rank"), answer.alias("answer"))).alias("best"), F.max("attempt").alias("last"))
    )
    found = F.struct(
        F.col("last").alias("attempts"), delivery_outcome(F.col("best.answer.status_code")).alias("outcome"),
        *[F.col(f"best.answer.{f}").alias(f) for f in ("delivered_at", "request_url", "status_code", "detail")],
    )
    return best.select("request_key", found.alias("delivery"))


def decide_with_deliveries(
    evaluations: DataFrame, retraining: RetrainingOptions, deliveries: DataFrame, **limits: int
) -> DataFrame:
    """``decide`` over a history of evaluations, with what deliveries answered so far.

    Adds ``request_key`` and ``delivery`` to the decisions. ``triggered`` is
    true once a delivery has succeeded.
    """
    keyed = evaluations.withColumn("request_key", request_key(event_id("evaluated_at", "status")))
    known = keyed.join(delivery_results(deliveries), "request_key", "left")
    decided = decide(known, retraining, outcome=F.coalesce("delivery.outcome", F.lit(TRIGGERED)), **limits)
    waiting = F.col("triggered") & F.col("delivery").isNull()
    return decided.withColumns({
        "trigger_status": F.when(waiting, F.lit(QUEUED)).otherwise(F.col("trigger_status")),
        "triggered": F.col("triggered") & ~waiting,
    })


class Outbox:
    """Requests and deliveries below a root, a folder per writer's batch.

    A batch that is written again replaces itself, so a killed writer leaves
    the same as one that went through.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _write(self, table: str, batch: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(partition_path(self.root, table, "part", batch))

    def enqueue(self, batch: int, requests: DataFrame) -> None:
        """Append requests as ``retraining_requests`` makes them."""
        self._write("requests", batch, requests)

    def record(self, batch: int, deliveries: DataFrame) -> None:
        """Append attempts, in the columns of ``DELIVERY_SCHEMA``."""
        self._write("deliveries", batch, deliveries)

    def requests(self) -> DataFrame | None:
        """Requests so far, each key once, however often it was decided."""
        found = read_if_present(self.spark, f"{self.root}/requests")
        return None if found is None else found.drop("part").dropDuplicates(["request_key"])

    def deliveries(self) -> DataFrame:
        found = read_if_present(self.spark, f"{self.root}/deliveries")
        return self.spark.createDataFrame([], DELIVERY_SCHEMA) if found is None else found.drop("part")

    def due(self, max_attempts: int) -> DataFrame | None:
        """Requests to send now, with ``next_attempt``: neither successful nor given up."""
        asked = self.requests()
        if asked is None:
            return None
        sent = asked.join(delivery_results(self.deliveries()), "request_key", "left")
        made = F.coalesce("delivery.attempts", F.lit(0))
        open_ = F.col("delivery").isNull() | ((F.col("delivery.outcome") != TRIGGERED) & (made < max_attempts))
        return sent.filter(open_).withColumn("next_attempt", made + 1).drop("delivery")
