"""Inputs that a plain table does not hold: broken contracts, odd files, missing scores, other backends."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.contract import contract_violations
from tidemark.operators.evaluate import ranking_metrics
from tidemark.operators.monitor import BATCH, KEY, decide, retraining_requests
from tidemark.operators.splits import assign_splits
from tidemark.options import DatasetOptions, RetrainingOptions, SplitOptions
from tidemark.session import new_folder
from tidemark.sources.delimited import oversized_rows, read_dataset
from workload import query, table
from workload.model_queries import _RANKS, _SCORED_SQL, _rounded, _scored_orders
from workload.monitor_queries import _EVALUATIONS, _evaluations

CONTRACT = DatasetOptions(
    target="o_orderstatus", positive_class="F", id_columns=("o_orderkey", "absent_id"),
    required_columns=("o_custkey", "absent_column"), numeric_features=("o_totalprice",),
)


@query(
    "contract_violations",
    """
    SELECT 'orders' AS case_name, section, 'absent' AS rule, detail FROM
      (VALUES ('data.id_columns', 'absent_id'), ('data.required_columns', 'absent_column')) v(section, detail)
    UNION ALL SELECT 'empty', section, 'absent', detail FROM
      (VALUES ('data.id_columns', 'absent_id'), ('data.required_columns', 'absent_column')) v(section, detail)
    UNION ALL SELECT 'empty', 'data.target_column', 'empty', '0'
    UNION ALL SELECT 'repeated', section, rule, detail FROM
      (VALUES ('data.id_columns', 'absent', 'absent_id'), ('data.required_columns', 'absent', 'absent_column'),
              ('columns', 'repeated', 'o_custkey')) v(section, rule, detail)
    UNION ALL SELECT 'one_class', section, 'absent', detail FROM
      (VALUES ('data.id_columns', 'absent_id'), ('data.required_columns', 'absent_column')) v(section, detail)
    UNION ALL SELECT 'one_class', 'data.target_column', 'two_classes', CAST(count(DISTINCT o_orderstatus) AS VARCHAR)
      FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'missing', section, 'absent', detail FROM
      (VALUES ('data.id_columns', 'absent_id'), ('data.required_columns', 'absent_column')) v(section, detail)
    UNION ALL SELECT 'missing', 'data.target_column', 'missing_target', CAST(count(*) AS VARCHAR)
      FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT 'no_target', section, 'absent', detail FROM
      (VALUES ('data.target_column', 'o_orderstatus'), ('data.id_columns', 'absent_id'),
              ('data.required_columns', 'absent_column')) v(section, detail)
    """,
)
def contract_violations_query(spark, sf):
    """Every broken rule of deliberately broken orders."""
    orders = table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    cases = {
        "orders": orders,
        "empty": orders.filter(F.lit(False)),
        "one_class": orders.filter(status == "F"),
        "missing": orders.withColumn("o_orderstatus", F.when(status != "P", status)),
        "no_target": orders.drop("o_orderstatus"),
        "repeated": orders.select("*", F.col("o_orderkey").alias("o_custkey")),
    }
    found = None
    for name, df in cases.items():
        rows = contract_violations(df, CONTRACT).select(F.lit(name).alias("case_name"), "section", "rule", "detail")
        found = rows if found is None else found.unionByName(rows)
    return found


@query(
    "contract_nan_target",
    """SELECT 'data.target_column' AS section, 'missing_target' AS rule, CAST(count(*) AS VARCHAR) AS detail
       FROM orders WHERE o_orderpriority = '5-LOW' HAVING count(*) > 0""",
)
def contract_nan_target(spark, sf):
    """A target that is not a number is a missing one."""
    orders = table(spark, sf, "orders").withColumn(
        "target",
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(float("nan")))
        .otherwise((F.col("o_orderstatus") == "F").cast("double")),
    )
    return contract_violations(orders, DatasetOptions(target="target", positive_class="1"))


@query(
    "auc_ap_missing_scores",
    _SCORED_SQL
    + """SELECT split, CASE WHEN split NOT IN ('1-URGENT', '2-HIGH') THEN roc_auc END AS roc_auc,
                CASE WHEN split NOT IN ('1-URGENT', '2-HIGH') THEN average_precision END AS average_precision FROM a""",
)
def auc_ap_missing_scores(spark, sf):
    """Splits in which a row has no score have no ranking metrics."""
    scored = _scored_orders(spark, sf)
    first = F.pmod(F.xxhash64("label", "probability"), F.lit(2)) == 0
    lost = F.when((F.col("split") == "1-URGENT") & first, F.lit(None).cast("double")).when(
        (F.col("split") == "2-HIGH") & first, F.lit(float("nan"))).otherwise(F.col("probability"))
    return _rounded(ranking_metrics(scored.withColumn("probability", lost), ["split"]), _RANKS)


@query(
    "split_assign_many_classes",
    """
    WITH o AS (SELECT o_orderkey, o_orderkey // 20 AS label FROM orders),
    sized AS (SELECT label, count(*) AS n FROM o GROUP BY 1),
    counts AS (SELECT * FROM sized WHERE n >= 4),
    t AS (SELECT sum(n) AS total, CAST(sum(n) - ceil(sum(n) * 0.5) AS BIGINT) AS kept FROM counts),
    s AS (SELECT label, n, CAST(n AS HUGEINT) * kept // total AS share, CAST(n AS HUGEINT) * kept % total AS rest,
                 kept FROM counts, t),
    e AS (SELECT *, row_number() OVER (ORDER BY rest DESC, label) AS place, kept - sum(share) OVER () AS extra FROM s),
    q AS (SELECT label, n - share - CAST(place <= extra AS INT) AS test FROM e),
    r AS (SELECT o_orderkey, o.label,
                 row_number() OVER (PARTITION BY o.label ORDER BY md5('7|' || o_orderkey), o_orderkey) AS rn
          FROM o JOIN counts USING (label))
    SELECT o_orderkey, r.label, CASE WHEN rn <= test THEN 'test' ELSE 'train' END AS split
    FROM r JOIN q ON q.label = r.label
    """,
)
def split_assign_many_classes(spark, sf):
    """A class for every twenty order keys: quotas are a table, not a dictionary."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 20).alias("label"))
    large = orders.groupBy("label").count().filter("count >= 4").select("label")
    return assign_splits(orders.join(large, "label"), "label", "o_orderkey", SplitOptions(0.5, 0, seed=7)).select(
        "o_orderkey", "label", "split"
    )


def _orders_options(**more):
    return DatasetOptions(target="o_orderstatus", positive_class="F", id_columns=("o_orderkey",), **more)


@query(
    "csv_reordered_headers",
    "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders",
)
def csv_reordered_headers(spark, sf):
    """Files whose columns stand in another order."""
    folder = new_folder(spark, "csv")
    text = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.format_string("%.2f", "o_totalprice").alias("o_totalprice")
    )
    early = F.col("o_orderkey") % 2 == 0
    text.filter(early).write.option("header", True).csv(folder)
    text.filter(~early).select("o_totalprice", "o_orderkey", "o_orderstatus").write.mode("append").option(
        "header", True).csv(folder)
    return read_dataset(spark, folder, _orders_options())


@query(
    "csv_quoted_breaks",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority || chr(10) || 'second, "line"' AS note FROM orders""",
)
def csv_quoted_breaks(spark, sf):
    """Line breaks, separators and quotes inside quoted values."""
    folder = new_folder(spark, "csv")
    note = F.concat("o_orderpriority", F.lit('\nsecond, "line"')).alias("note")
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", note).write.option("header", True).option(
        "escape", '"').csv(folder)
    return read_dataset(spark, folder, _orders_options())


@query(
    "csv_extra_fields",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 100 = 0""",
)
def csv_extra_fields(spark, sf):
    """Rows with more fields than the header has names."""
    folder = new_folder(spark, "csv")
    extra = F.when(F.col("o_orderkey") % 100 == 0, F.lit(",EXTRA")).otherwise(F.lit(""))
    lines = table(spark, sf, "orders").select(
        F.concat(F.col("o_orderkey").cast("string"), F.lit(","), "o_orderstatus", extra).alias("value"))
    # every task writes a file of its own, and each has its header in the first line
    named = lines.withColumnRenamed("value", "o_orderkey,o_orderstatus")
    named.write.option("header", "true").option("quote", "").option("escapeQuotes", "false").option("sep", "\u0001").csv(folder)
    return oversized_rows(spark, folder, _orders_options())


_CHANGES = f"WITH RECURSIVE {_EVALUATIONS} "


@query(
    "retraining_backend_disabled",
    _CHANGES
    + """SELECT monitor_key, batch_id, false AS attempted, false AS triggered,
                CASE WHEN status = 'drift_detected' THEN 'disabled' END AS trigger_status FROM changes""",
)
def retraining_backend_disabled(spark, sf):
    """The disabled backend answers without an attempt, whatever a delivery would say."""
    options = RetrainingOptions(cooldown_minutes=2880, backend="disabled")
    decided = decide(_evaluations(spark, sf), options, outcome=F.lit("triggered"))
    return decided.select(KEY, BATCH, "attempted", "triggered", "trigger_status")


@query(
    "retraining_misconfigured",
    _CHANGES
    + "SELECT monitor_key, batch_id, 'misconfigured' AS outcome FROM changes WHERE status = 'drift_detected'",
)
def retraining_misconfigured(spark, sf):
    """Without a workflow every attempt is misconfigured, whatever a delivery would say; none starts a cooldown."""
    options = RetrainingOptions(cooldown_minutes=2880, workflow_id=None)
    decided = decide(_evaluations(spark, sf), options, outcome=F.lit("triggered"))
    return retraining_requests(decided, options).select(KEY, BATCH, "outcome")
