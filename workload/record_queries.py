"""Contract checks, coercion, keys, schema alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import (
    event_id,
    feature_list,
    method_label,
    monitor_key,
    negative_label,
    normalize_category,
    route_label,
    run_id_of_uri,
    sanitize_key,
    status_family,
    to_number,
)
from tidemark.operators.contract import (
    RecordRule,
    check_records,
    column_presence,
    contract_report,
    rejected_records,
    request_sizes,
    target_distribution,
    valid_records,
)
from tidemark.operators.envelopes import check_requests, request_records
from tidemark.operators.features import align_schema, normalize_categories, prepare
from tidemark.options import DatasetOptions
from tidemark.sources.delimited import apply_types, inferred_types, read_parquet_dataset
from workload import query, table

ORDERS = DatasetOptions(
    target="order_status",
    positive_class="F",
    renames={"o_orderstatus": "order_status"},
    id_columns=("o_orderkey",),
    drop_columns=("o_custkey",),
    required_columns=("o_orderkey", "o_totalprice", "order_status"),
    numeric_features=("o_totalprice",),
    categorical_features=("o_orderpriority",),
)


@query(
    "contract_report",
    """
    WITH d AS (SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1)
    SELECT CAST(sum(n) OVER () AS BIGINT) AS row_count, 6 AS column_count, count(*) OVER () AS class_count,
           'o_custkey,o_orderdate,o_orderkey,o_orderpriority,o_totalprice,order_status'
             AS validated_columns, label, n AS class_rows
    FROM d
    """,
)
def contract_report_query(spark, sf):
    """The report beside its distribution, one row per class."""
    df = read_parquet_dataset(spark, f"{sf}/orders.parquet", ORDERS)
    report = contract_report(df, ORDERS)
    classes = target_distribution(df, ORDERS).withColumnRenamed("row_count", "class_rows")
    # the report is one row
    return classes.join(F.broadcast(report.withColumn("one", F.lit(1))), F.col("one") == 1).select(
        "row_count", "column_count", "class_count",
        F.array_join("validated_columns", ",").alias("validated_columns"), "label", "class_rows",
    )


@query(
    "target_distribution",
    "SELECT o_orderstatus AS label, count(*) AS row_count FROM orders GROUP BY 1",
)
def target_distribution_query(spark, sf):
    return target_distribution(read_parquet_dataset(spark, f"{sf}/orders.parquet", ORDERS), ORDERS)


@query(
    "contract_columns",
    """
    WITH c AS (
      SELECT count(o_orderkey) AS k, count(o_totalprice) AS p, count(o_orderpriority) AS q,
             count(o_orderstatus) AS s FROM orders)
    SELECT 'data.target_column' AS section, 'order_status' AS "column", true AS present, s AS value_count FROM c
    UNION ALL SELECT 'data.id_columns', 'o_orderkey', true, k FROM c
    UNION ALL SELECT 'data.drop_columns', 'o_comment', false, 0 FROM c
    UNION ALL SELECT 'data.numeric_features', 'o_totalprice', true, p FROM c
    UNION ALL SELECT 'data.numeric_features', 'o_weight', false, 0 FROM c
    UNION ALL SELECT 'data.categorical_features', 'o_orderpriority', true, q FROM c
    """,
)
def contract_columns(spark, sf):
    options = DatasetOptions(
        target="order_status", renames={"o_orderstatus": "order_status"},
        id_columns=("o_orderkey",), drop_columns=("o_comment",),
        numeric_features=("o_totalprice", "o_weight"), categorical_features=("o_orderpriority",),
    )
    return column_presence(read_parquet_dataset(spark, f"{sf}/orders.parquet", options), options)


def _event_texts(spark, sf):
    """Event columns as the texts a delimited file would hold."""
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    return ev.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.format_string("%.2f", "value").alias("value"),
        F.when(F.col("event_type") == "error", F.lit(None)).otherwise(k).alias("k"),
        F.when(F.col("value") > 50, "True").otherwise("false").alias("large"),
        "event_type",
        F.concat(k, F.when(F.col("event_type") == "view", "d").otherwise("")).alias("mixed"),
        F.when(F.col("value") < 0, "x").alias("blank"),
    )


@query(
    "type_inference",
    r"""
    WITH t AS (
      SELECT event_type, value,
             CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS k,
             json_extract_string(props, '$.k') || CASE WHEN event_type = 'view' THEN 'd' ELSE '' END AS mixed
      FROM events)
    SELECT 'event_id' AS "column", 'bigint' AS inferred_type
    UNION ALL SELECT 'value', 'double'
    UNION ALL SELECT 'k', CASE WHEN bool_and(regexp_full_match(k, '[+-]?\d+')) THEN 'bigint' ELSE 'other' END FROM t
    UNION ALL SELECT 'large', 'boolean'
    UNION ALL SELECT 'event_type', 'string'
    UNION ALL SELECT 'mixed', CASE WHEN bool_and(try_cast(mixed AS DOUBLE) IS NOT NULL) THEN 'other' ELSE 'string' END FROM t
    UNION ALL SELECT 'blank', CASE WHEN bool_or(value < 0) THEN 'string' ELSE 'double' END FROM t
    """,
)
def type_inference(spark, sf):
    return inferred_types(_event_texts(spark, sf))


@query(
    "typed_table",
    """
    SELECT event_id, round(value, 2) AS value,
           CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
           value > 50 AS large
    FROM events
    """,
)
def typed_table(spark, sf):
    text = _event_texts(spark, sf)
    kinds = {r["column"]: r["inferred_type"] for r in inferred_types(text).collect()}
    return apply_types(text, kinds).select(
        "event_id", F.round("value", 2).alias("value"), "k", "large"
    )


RULES = [
    RecordRule("event_type", "choice", choices=("click", "view", "signup", "purchase")),
    RecordRule("user", "text"),
    RecordRule("value", "number", minimum=5),
    RecordRule("k", "integer", minimum=10),
    RecordRule("total", "number", minimum=0, optional=True),
]


def _records(spark, sf):
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    total = (
        F.when(F.col("event_type") == "view", "  ")
        .when(F.col("event_type") == "signup", "not-a-number")
        .otherwise(F.col("value").cast("string"))
    )
    payload = F.when(F.col("event_type") == "purchase", F.replace("props", F.lit("}"), F.lit(', "note": 1}')))
    return ev.select(
        "event_id", "event_type", "value", k.alias("k"), total.alias("total"),
        F.when(F.col("user_id") % 10 > 0, F.col("user_id").cast("string")).otherwise(" \t").alias("user"),
        payload.otherwise(F.col("props")).alias("payload"),
    )


_RECORDS_SQL = """
    WITH r AS (
      SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id
      FROM events),
    e AS (
      SELECT *, concat_ws(',',
        CASE WHEN event_type NOT IN ('click', 'view', 'signup', 'purchase') THEN 'event_type:choice' END,
        CASE WHEN user_id % 10 = 0 THEN 'user:text' END,
        CASE WHEN value < 5 THEN 'value:number' END,
        CASE WHEN k < 10 THEN 'k:integer' END,
        CASE WHEN event_type = 'signup' THEN 'total:number' END,
        CASE WHEN event_type = 'purchase' THEN 'note:extra' END) AS errors
      FROM r)
"""


@query(
    "records_valid",
    _RECORDS_SQL + "SELECT event_id, value, CAST(k AS VARCHAR) AS k FROM e WHERE errors = ''",
)
def records_valid(spark, sf):
    checked = check_records(_records(spark, sf), RULES, payload="payload")
    return valid_records(checked).select("event_id", "value", "k")


@query("records_rejected", _RECORDS_SQL + "SELECT event_id, errors FROM e WHERE errors <> ''")
def records_rejected(spark, sf):
    checked = check_records(_records(spark, sf), RULES, payload="payload")
    return rejected_records(checked).select("event_id", F.array_join("errors", ",").alias("errors"))


@query(
    "request_sizes",
    """
    SELECT l_suppkey AS request_id, count(*) AS record_count, count(*) BETWEEN 1 AND 600 AS accepted
    FROM lineitem GROUP BY 1
    """,
)
def request_sizes_query(spark, sf):
    log = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("request_id"))
    return request_sizes(log, "request_id", maximum=600)


ENVELOPE_RULES = [
    RecordRule("customer", "integer", minimum=0),
    RecordRule("priority", "text"),
    RecordRule("status", "choice", choices=("F", "O")),
    RecordRule("total", "number", minimum=0, optional=True),
]


def _request_bodies(spark, sf):
    """Request bodies out of orders: empty lists, unknown keys, odd records and broken texts among them."""
    key = F.col("o_orderkey")
    total = F.when(key % 11 == 0, '"n/a"').when(key % 11 == 1, '" "').when(key % 11 == 2, "null").otherwise(
        F.concat(F.lit('"'), key.cast("string"), F.lit('"')))
    record = F.concat(
        F.lit('{"customer": '), F.col("o_custkey").cast("string"), F.lit(', "priority": "'), F.col("o_orderpriority"),
        F.lit('", "status": "'), F.col("o_orderstatus"), F.lit('", "total": '), total,
        F.when(key % 13 == 0, ', "note": 1').otherwise(""), F.lit("}"))
    records = F.array_join(F.array_repeat(record, (key % 7).cast("int")), ", ")
    listed = F.concat(F.lit('"instances": ['), records, F.lit("]"))
    body = (
        F.when(key % 10 == 0, F.concat(F.lit('{"trace": 1, '), listed, F.lit("}")))
        .when(key % 10 == 1, F.concat(F.lit("{"), listed))
        .when(key % 10 == 2, F.lit('{"rows": []}'))
        .when(key % 10 == 3, F.concat(F.lit('{"instances": '), record, F.lit("}")))
        .when(key % 10 == 4, F.lit('{"instances": [1, null]}'))
        .otherwise(F.concat(F.lit("{"), listed, F.lit("}")))
    )
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), body.alias("body"))


_BODIES_SQL = """
    WITH t AS (SELECT *, CASE o_orderkey % 11 WHEN 0 THEN '"n/a"' WHEN 1 THEN '" "' WHEN 2 THEN 'null'
                              ELSE '"' || o_orderkey || '"' END AS total FROM orders),
    r AS (SELECT o_orderkey AS request_id, '{"customer": ' || o_custkey || ', "priority": "' || o_orderpriority
                 || '", "status": "' || o_orderstatus || '", "total": ' || total
                 || CASE WHEN o_orderkey % 13 = 0 THEN ', "note": 1' ELSE '' END || '}' AS record FROM t),
    l AS (SELECT *, '"instances": [' || array_to_string([record FOR i IN range(request_id % 7)], ', ') || ']' AS listed
          FROM r),
    b AS (SELECT request_id, CASE request_id % 10 WHEN 0 THEN '{"trace": 1, ' || listed || '}' WHEN 1 THEN '{' || listed
                 WHEN 2 THEN '{"rows": []}' WHEN 3 THEN '{"instances": ' || record || '}'
                 WHEN 4 THEN '{"instances": [1, null]}' ELSE '{' || listed || '}' END AS body FROM l),
    p AS (SELECT request_id, json_valid(body) AS valid, CASE WHEN json_valid(body) THEN body END::JSON AS body FROM b),
    k AS (SELECT *, list_sort(json_keys(body)) AS keys, json_type(body, '$.instances') AS kind,
                 coalesce(json_array_length(body, '$.instances'), 0) AS n FROM p),
    x AS (SELECT request_id, unnest(json_extract(body, '$.instances[*]')) AS record,
                 generate_subscripts(json_extract(body, '$.instances[*]'), 1) - 1 AS pos FROM k WHERE kind = 'ARRAY')
"""


@query(
    "request_envelopes",
    _BODIES_SQL
    + """,
    f AS (SELECT request_id, pos, record, json_type(record) AS kind, trim(record->>'customer') AS customer,
                 trim(record->>'priority') AS priority, trim(record->>'status') AS status,
                 nullif(trim(record->>'total'), '') AS total FROM x),
    v AS (SELECT request_id, pos, CASE WHEN kind <> 'OBJECT' THEN ['record:object'] ELSE [y FOR y IN [
            CASE WHEN coalesce(try_cast(customer AS DOUBLE) >= 0, false) THEN NULL ELSE 'customer:integer' END,
            CASE WHEN coalesce(priority, '') = '' THEN 'priority:text' END,
            CASE WHEN coalesce(status, '') NOT IN ('F', 'O') THEN 'status:choice' END,
            CASE WHEN total IS NOT NULL AND coalesce(try_cast(total AS DOUBLE) < 0, true) THEN 'total:number' END,
            CASE WHEN list_contains(json_keys(record), 'note') THEN 'note:extra' END] IF y IS NOT NULL] END AS errors
          FROM f),
    w AS (SELECT request_id, string_agg('instances.' || pos || '.' || error, ',' ORDER BY pos, nth) AS errors
          FROM (SELECT request_id, pos, unnest(errors) AS error, generate_subscripts(errors, 1) AS nth FROM v) GROUP BY 1),
    e AS (SELECT request_id, n, CASE WHEN NOT valid THEN 'body:json' ELSE concat_ws(',',
            CASE WHEN NOT list_contains(keys, 'instances') THEN 'instances:missing' WHEN kind <> 'ARRAY' THEN 'instances:array'
                 WHEN n < 1 THEN 'instances:too_short' WHEN n > 5 THEN 'instances:too_long' END,
            nullif(array_to_string([y || ':extra' FOR y IN keys IF y <> 'instances'], ','), ''), w.errors) END AS errors
          FROM k LEFT JOIN w USING (request_id))
    SELECT request_id, CAST(n AS INT) AS record_count, errors, errors = '' AS accepted FROM e
    """,
)
def request_envelopes(spark, sf):
    """Requests as they come, checked whole: empty ones and unknown keys are seen."""
    checked = check_requests(_request_bodies(spark, sf), "body", ENVELOPE_RULES, maximum=5)
    return checked.select("request_id", "record_count", F.array_join("errors", ",").alias("errors"), "accepted")


@query(
    "request_records",
    _BODIES_SQL
    + """SELECT request_id, CAST(pos AS INT) AS record_pos, record->>'customer' AS customer,
                record->>'priority' AS priority, record->>'total' AS total FROM x""",
)
def request_records_query(spark, sf):
    """The records of all requests that have a list of them."""
    return request_records(_request_bodies(spark, sf), "body", ["customer", "priority", "total"]).drop("record")


@query(
    "coerce_numeric",
    r"""
    WITH r AS (
      SELECT event_id, value, CASE event_id % 10
        WHEN 0 THEN '  ' || event_id || ' ' WHEN 1 THEN event_id || 'd' WHEN 2 THEN event_id || 'e2'
        WHEN 3 THEN '0x' || event_id WHEN 4 THEN event_id || '_000' WHEN 5 THEN '+.' || event_id
        WHEN 6 THEN '-' || event_id || '.5' WHEN 7 THEN '' WHEN 8 THEN event_id || ',000'
        ELSE '1.' END AS raw
      FROM events)
    SELECT event_id, raw, CASE
        WHEN regexp_full_match(trim(raw), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?')
        THEN round(try_cast(trim(raw) AS DOUBLE), 6) END AS number
    FROM r
    """,
)
def coerce_numeric_query(spark, sf):
    key = F.col("event_id").cast("string")
    shapes = [
        F.concat(F.lit("  "), key, F.lit(" ")),
        F.concat(key, F.lit("d")),
        F.concat(key, F.lit("e2")),
        F.concat(F.lit("0x"), key),
        F.concat(key, F.lit("_000")),
        F.concat(F.lit("+."), key),
        F.concat(F.lit("-"), key, F.lit(".5")),
        F.lit(""),
        F.concat(key, F.lit(",000")),
        F.lit("1."),
    ]
    raw = F.element_at(F.array(*shapes), (F.col("event_id") % 10 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", raw.alias("raw")).withColumn(
        "number", F.round(to_number("raw"), 6)
    )


@query(
    "encode_target",
    """
    SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INT) AS order_year, o_orderpriority,
           CAST(o_orderstatus = 'F' AS INT) AS label
    FROM orders
    """,
)
def encode_target_query(spark, sf):
    orders = table(spark, sf, "orders")
    raw = orders.select(
        "o_orderkey", "o_custkey",
        F.format_string("%.2f", "o_totalprice").alias("o_totalprice"),
        F.year("o_orderdate").alias("order_year"), "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", " yes").otherwise("no ").alias("final"),
    )
    options = DatasetOptions(
        target="final", positive_class="yes", id_columns=("o_orderkey",), drop_columns=("o_custkey",),
        numeric_features=("o_totalprice",), numeric_coercion_columns=("o_totalprice",),
        infer_remaining_features=True,
    )
    prepared, spec = prepare(raw, options, keep=("o_orderkey",))
    return prepared.select("o_orderkey", *spec.all, "label")


@query(
    "align_schema",
    """
    SELECT c_mktsegment, c_acctbal, CAST(NULL AS VARCHAR) AS c_phone, c_custkey,
           CAST(NULL AS DOUBLE) AS c_discount
    FROM customer
    """,
)
def align_schema_query(spark, sf):
    customer = table(spark, sf, "customer").withColumn(
        "c_acctbal", F.format_string("%.2f", "c_acctbal")
    )
    expected = {"c_mktsegment": "string", "c_acctbal": "double", "c_phone": "string",
                "c_custkey": "bigint", "c_discount": "double"}
    return align_schema(customer, expected, coerce=["c_acctbal", "c_discount"])


@query(
    "normalize_categories",
    """
    SELECT p_partkey, CASE WHEN p_size % 5 IN (0, 1) THEN '__missing__' ELSE p_brand END AS p_brand
    FROM part
    """,
)
def normalize_categories_query(spark, sf):
    shaped = (
        F.when(F.col("p_size") % 5 == 0, F.lit(" \t "))
        .when(F.col("p_size") % 5 == 1, F.lit(None))
        .otherwise(F.concat(F.lit(" \n"), F.col("p_brand"), F.lit("\t")))
    )
    part = table(spark, sf, "part").select("p_partkey", shaped.alias("p_brand"))
    return normalize_categories(part, ["p_brand"])


@query(
    "sanitize_keys",
    r"""
    SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'),
             '^[._]+|[._]+$', '', 'g'), ''), 'drift_monitor') AS monitor_key
    FROM pages
    """,
)
def sanitize_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", sanitize_key("url").alias("monitor_key"))


@query(
    "monitor_keys",
    r"""
    WITH p AS (
      SELECT page_id, url,
             CASE WHEN page_id % 3 = 0 THEN 'runs:/' || page_id || '/model' ELSE url END AS uri,
             CASE WHEN page_id % 3 = 1 THEN 'm:' || page_id END AS name,
             CASE WHEN page_id % 3 = 1 THEN CAST(page_id AS VARCHAR) END AS version FROM pages),
    k AS (
      SELECT page_id, nullif(regexp_extract(uri, '^runs:/([^/]*)', 1), '') AS run_id, name, version, uri FROM p)
    SELECT page_id, run_id,
           regexp_replace(regexp_replace(coalesce('run_' || run_id, 'registry_' || name || '_v' || version,
             'uri_' || substring(sha1(uri), 1, 12)), '[^A-Za-z0-9_.-]+', '_', 'g'),
             '^[._]+|[._]+$', '', 'g') AS monitor_key
    FROM k
    """,
)
def monitor_keys(spark, sf):
    p = F.col("page_id")
    text = p.cast("string")
    pages = table(spark, sf, "pages").select(
        "page_id",
        F.when(p % 3 == 0, F.concat(F.lit("runs:/"), text, F.lit("/model")))
        .otherwise(F.col("url")).alias("uri"),
        F.when(p % 3 == 1, F.concat(F.lit("m:"), text)).alias("name"),
        F.when(p % 3 == 1, text).alias("version"),
    )
    keyed = pages.withColumn("run_id", run_id_of_uri("uri"))
    return keyed.select(
        "page_id", "run_id",
        monitor_key("run_id", "name", "version", F.lit("uri"), "uri").alias("monitor_key"),
    )


@query(
    "sortable_ids",
    """
    SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S%fZ') || '_' || event_type AS id FROM events
    """,
)
def sortable_ids(spark, sf):
    ev = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return ev.select("event_id", event_id("at", "event_type").alias("id"))


@query(
    "request_labels",
    """
    SELECT event_id, upper(event_type) AS method,
           CASE WHEN event_type = 'error' THEN '/unmatched' ELSE '/v1/' || event_type END AS route,
           CASE WHEN value >= 400 AND value < 500 THEN 'client_error' WHEN value >= 500 THEN 'server_error'
                ELSE 'success' END AS family
    FROM events
    """,
)
def request_labels(spark, sf):
    ev = table(spark, sf, "events")
    route = F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("/v1/"), F.col("event_type")))
    return ev.select(
        "event_id", method_label("event_type").alias("method"),
        route_label(route).alias("route"), status_family("value").alias("family"),
    )


@query(
    "resolved_lists",
    """
    WITH c AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderstatus))) AS classes FROM orders GROUP BY 1)
    SELECT o_custkey,
           CASE WHEN len(list_filter(classes, lambda x: x <> 'F')) > 0
                THEN list_filter(classes, lambda x: x <> 'F')[1] END AS negative_label,
           CASE WHEN len(list_filter(classes, lambda x: x = 'P')) > 0 THEN 'P' ELSE 'tenure,charges' END AS features
    FROM c
    """,
)
def resolved_lists(spark, sf):
    # a customer has at most the three order states, so the set per key is small
    classes = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.collect_set("o_orderstatus").alias("classes")
    )
    partial = F.filter("classes", lambda x: x == "P")
    return classes.select(
        "o_custkey", negative_label("classes", "F").alias("negative_label"),
        F.array_join(feature_list(partial, ["tenure", "charges"]), ",").alias("features"),
    )


@query(
    "category_values",
    """
    SELECT coalesce(nullif(trim(o_orderpriority), ''), '__missing__') AS priority, count(*) AS row_count
    FROM orders GROUP BY 1
    """,
)
def category_values(spark, sf):
    return (
        table(spark, sf, "orders")
        .groupBy(normalize_category("o_orderpriority").alias("priority"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
