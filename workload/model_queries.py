"""Splits, fitted transforms, classification metrics, training and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.evaluate import (
    classification_metrics,
    confusion_metrics,
    metrics_long,
    ranking_metrics,
)
from tidemark.operators.model import prediction_rows, score, train
from tidemark.operators.splits import assign_splits, split_sizes
from tidemark.operators.transforms import (
    category_dictionary,
    encode_sparse,
    fit_categories,
    fit_numeric,
    impute_onehot,
    impute_scale,
    modes,
    value_counts,
)
from tidemark.options import FeatureSpec, ModelOptions, SplitOptions
from tidemark.plans.local import small_table
from workload import query, table

SPLIT = SplitOptions(test_size=0.2, validation_size=0.1, seed=42)


def quotas_sql(test: str, validation: str) -> str:
    """CTE body with one row per class: rows of test and validation.

    Held-out rows are rounded up; the training share of a class is its floor plus
    one for the largest remainders, the smaller class first.
    """
    share = """
      SELECT label, n, CASE WHEN rk <= draws - sum(base) OVER () THEN base + 1 ELSE base END AS kept FROM (
        SELECT label, n, draws, n * draws // total AS base,
               row_number() OVER (ORDER BY n * draws % total DESC, label) AS rk
        FROM (SELECT label, n, CAST(sum(n) OVER () AS BIGINT) AS total,
                     CAST(sum(n) OVER () - ceil(sum(n) OVER () * {frac}) AS BIGINT) AS draws FROM {src}))
    """
    first = share.format(frac=f"CAST({test} AS DOUBLE)", src="counts")
    second = share.format(
        frac=f"(CAST({validation} AS DOUBLE) / (1 - CAST({test} AS DOUBLE)))", src="pool"
    )
    return f"""
    t AS ({first}), pool AS (SELECT label, kept AS n FROM t), v AS ({second}),
    quotas AS (SELECT t.label, t.n - t.kept AS test, v.n - v.kept AS validation FROM t JOIN v USING (label))
    """


_SPLIT_SQL = f"""
    WITH o AS (SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS label FROM orders),
    counts AS (SELECT label, count(*) AS n FROM o GROUP BY 1),
    {quotas_sql('0.2', '0.1')},
    r AS (SELECT o_orderkey, label,
                 row_number() OVER (PARTITION BY label ORDER BY md5('42|' || o_orderkey), o_orderkey) AS rn FROM o),
    s AS (SELECT o_orderkey, r.label, CASE WHEN rn <= test THEN 'test' WHEN rn <= test + validation THEN 'validation'
                 ELSE 'train' END AS split FROM r JOIN quotas q ON q.label = r.label)
"""


def _labelled_orders(spark, sf):
    return table(spark, sf, "orders").withColumn(
        "label", (F.col("o_orderstatus") == "F").cast("int")
    )


@query("split_assign", _SPLIT_SQL + "SELECT o_orderkey, label, split FROM s")
def split_assign(spark, sf):
    orders = _labelled_orders(spark, sf).select("o_orderkey", "label")
    return assign_splits(orders, "label", "o_orderkey", SPLIT)


@query("split_assign_cells", _SPLIT_SQL + "SELECT o_orderkey, label, split FROM s")
def split_assign_cells(spark, sf):
    orders = _labelled_orders(spark, sf).select("o_orderkey", "label")
    return assign_splits(orders, "label", "o_orderkey", SPLIT, rows_per_cell=100)


@query("split_sizes", _SPLIT_SQL + "SELECT split, label, count(*) AS row_count FROM s GROUP BY 1, 2")
def split_sizes_query(spark, sf):
    return split_sizes(split_assign(spark, sf), ("split", "label"))


def _accounts(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_nationkey") != 3, F.col("c_nationkey").cast("double")).alias("c_nationkey"),
    )


_ACCOUNTS_SQL = """
    WITH a AS (SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS bal,
                      CASE WHEN c_nationkey <> 3 THEN CAST(c_nationkey AS DOUBLE) END AS nat FROM customer),
    m AS (SELECT median(bal) AS mb, median(nat) AS mn FROM a),
    f AS (SELECT c_custkey, coalesce(bal, mb) AS bal, coalesce(nat, mn) AS nat FROM a, m),
    s AS (SELECT avg(bal) AS ab, stddev_pop(bal) AS sb, avg(nat) AS an, stddev_pop(nat) AS sn FROM f)
"""


@query(
    "impute_scale",
    _ACCOUNTS_SQL
    + """SELECT c_custkey, round((bal - ab) / sb, 6) AS c_acctbal, round((nat - an) / sn, 6) AS c_nationkey
         FROM f, s""",
)
def impute_scale_query(spark, sf):
    accounts = _accounts(spark, sf)
    scaled = impute_scale(accounts, fit_numeric(accounts, ["c_acctbal", "c_nationkey"]))
    return scaled.withColumns({c: F.round(c, 6) for c in ("c_acctbal", "c_nationkey")})


@query(
    "scaling_statistics",
    _ACCOUNTS_SQL
    + """SELECT 'c_acctbal' AS feature, round(mb, 6) AS median, round(ab, 6) AS mean, round(sb, 6) AS std FROM m, s
         UNION ALL SELECT 'c_nationkey', round(mn, 6), round(an, 6), round(sn, 6) FROM m, s""",
)
def scaling_statistics(spark, sf):
    fits = fit_numeric(_accounts(spark, sf), ["c_acctbal", "c_nationkey"])
    # one row per feature
    rows = [(f.name, f.median, f.mean, f.std) for f in fits]
    found = small_table(spark, rows, "feature string, median double, mean double, std double")
    return found.withColumns({c: F.round(c, 6) for c in ("median", "mean", "std")})


@query(
    "modes",
    """
    WITH v AS (SELECT 'p_brand' AS feature, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part),
    c AS (SELECT feature, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2)
    SELECT feature, value AS mode FROM c
    QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) = 1
    """,
)
def modes_query(spark, sf):
    return modes(value_counts(table(spark, sf, "part"), ["p_brand", "p_type"]))


@query(
    "onehot_many_categories",
    """
    WITH l AS (SELECT l_orderkey, l_linenumber,
                      CASE WHEN l_linenumber <> 7 THEN l_orderkey || '-' || l_linenumber END AS line,
                      l_partkey || '-' || l_suppkey || '-' || l_orderkey AS place FROM lineitem),
    c AS (SELECT f, v, count(*) AS n FROM (SELECT 1 AS f, line AS v FROM l UNION ALL SELECT 2, place FROM l)
          WHERE v IS NOT NULL GROUP BY ALL),
    d AS (SELECT *, row_number() OVER (ORDER BY f, v) - 1 AS index,
                 row_number() OVER (PARTITION BY f ORDER BY n DESC, v) = 1 AS mode FROM c)
    SELECT l_orderkey, l_linenumber, 'line' AS feature, index, 1.0::DOUBLE AS value
    FROM l JOIN d ON d.f = 1 AND d.v = coalesce(line, (SELECT v FROM d WHERE f = 1 AND mode))
    UNION ALL SELECT l_orderkey, l_linenumber, 'place', index, 1.0::DOUBLE FROM l JOIN d ON d.f = 2 AND d.v = place
    """,
)
def onehot_many_categories(spark, sf):
    """Two columns with about as many categories as rows, as sparse rows."""
    key = F.col("l_orderkey").cast("string")
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") != 7, F.concat_ws("-", key, "l_linenumber")).alias("line"),
        F.concat_ws("-", "l_partkey", "l_suppkey", key).alias("place"),
    )
    features = ["line", "place"]
    dictionary = category_dictionary(lines, features)
    return encode_sparse(lines, features, dictionary, ["l_orderkey", "l_linenumber"])


@query(
    "impute_onehot",
    """
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS p FROM orders),
    m AS (SELECT p AS mode FROM o WHERE p <> '5-LOW' GROUP BY 1 ORDER BY count(*) DESC, p LIMIT 1),
    f AS (SELECT o_orderkey, coalesce(p, mode) AS p FROM o, m)
    SELECT o_orderkey, CAST(p = '1-URGENT' AS DOUBLE) AS "p_1-URGENT", CAST(p = '2-HIGH' AS DOUBLE) AS "p_2-HIGH",
           CAST(p = '3-MEDIUM' AS DOUBLE) AS "p_3-MEDIUM", CAST(p = '4-NOT SPECIFIED' AS DOUBLE) AS "p_4-NOT SPECIFIED"
    FROM f
    """,
)
def impute_onehot_query(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("p")
    )
    # the lowest priority is kept out of the fit, so it is an unseen value
    fits = fit_categories(orders.filter(F.col("p") != "5-LOW"), ["p"])
    return impute_onehot(orders, fits)


def _scored_orders(spark, sf):
    """Orders with a label, a score with many ties, and some missing scores."""
    score_ = F.round(F.col("o_totalprice") / 500000, 2)
    return _labelled_orders(spark, sf).select(
        F.col("o_orderpriority").alias("split"), "label", score_.alias("probability"),
        (score_ >= 0.5).cast("int").alias("predicted_class"),
    )


_METRICS = """
    c AS (SELECT split, count(*) AS support, count(*) FILTER (y = 0 AND p = 0) AS tn,
                 count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn,
                 count(*) FILTER (y = 1 AND p = 1) AS tp FROM q GROUP BY 1),
    g AS (SELECT split, score, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS n FROM q GROUP BY 1, 2),
    w AS (SELECT *, sum(p) OVER o AS cp, sum(n) OVER o AS cn FROM g
          WINDOW o AS (PARTITION BY split ORDER BY score DESC)),
    a AS (SELECT split, round(sum(n * (cp - p / 2)) / (sum(p) * sum(n)), 9) AS roc_auc,
                 round(sum(p * cp / (cp + cn)) / sum(p), 9) AS average_precision FROM w GROUP BY 1),
    m AS (SELECT c.split, support, tn AS true_negatives, fp AS false_positives, fn AS false_negatives,
                 tp AS true_positives, round((tp + tn) / support, 9) AS accuracy,
                 round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision,
                 round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
                 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM c)
"""
_SCORED_SQL = """
    WITH s AS (SELECT o_orderpriority AS split, CAST(o_orderstatus = 'F' AS INT) AS y,
                      round(o_totalprice / 500000, 2) AS score FROM orders),
    q AS (SELECT *, CAST(score >= CAST(0.5 AS DOUBLE) AS INT) AS p FROM s),""" + _METRICS
_RATIOS = ("accuracy", "precision", "recall", "f1")
_RANKS = ("roc_auc", "average_precision")


def _rounded(df, names):
    return df.withColumns({n: F.round(n, 9) for n in names})


_LONG = ", x AS (SELECT m.*, roc_auc, average_precision FROM m JOIN a USING (split)) " + " UNION ALL ".join(
    f"SELECT split, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM x"
    for n in (
        *_RATIOS, *_RANKS, "support", "true_negatives", "false_positives", "false_negatives", "true_positives",
    )
)


@query("confusion_metrics", _SCORED_SQL + "SELECT * FROM m")
def confusion_metrics_query(spark, sf):
    return _rounded(confusion_metrics(_scored_orders(spark, sf), ["split"]), _RATIOS)


@query("auc_ap", _SCORED_SQL + "SELECT * FROM a")
def auc_ap(spark, sf):
    return _rounded(ranking_metrics(_scored_orders(spark, sf), ["split"]), _RANKS)


@query("auc_ap_blocks", _SCORED_SQL + "SELECT * FROM a")
def auc_ap_blocks(spark, sf):
    edges = [i / 16 for i in range(1, 16)]
    return _rounded(ranking_metrics(_scored_orders(spark, sf), ["split"], edges=edges), _RANKS)


@query("classification_metrics", _SCORED_SQL + "SELECT m.*, roc_auc, average_precision FROM m JOIN a USING (split)")
def classification_metrics_query(spark, sf):
    return _rounded(classification_metrics(_scored_orders(spark, sf)), (*_RATIOS, *_RANKS))


@query(
    "metrics_long",
    _SCORED_SQL
    + _LONG,
)
def metrics_long_query(spark, sf):
    return metrics_long(classification_metrics_query(spark, sf))


LINE_SPEC = FeatureSpec(
    ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), ("l_linestatus", "l_shipmonth")
)


def _returned_lines(spark, sf):
    """Line items with a label their price explains in part, and missing inputs."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_partkey",
        "l_quantity",
        F.when(F.col("l_tax") > 0, F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("l_price"),
        F.when(F.col("l_returnflag") != "A", F.month("l_shipdate").cast("string")).alias("l_shipmonth"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) > 45000).cast("int").alias("label"),
    ).withColumn(
        # the table has no key of its own; equal rows are equal in every feature
        "row_key",
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.date_format("l_shipdate", "yyyyMMdd"),
                    *[F.floor(F.col(c) * 100) for c in ("l_quantity", "l_price", "l_discount", "l_tax")]),
    ).drop("l_price")


LINE_MODEL = ModelOptions(decision_threshold=0.4, solver="newton")


def trained_lines(spark, sf):
    lines = _returned_lines(spark, sf).select("row_key", "l_suppkey", "label", *LINE_SPEC.all)
    split = assign_splits(lines, "label", "row_key", SPLIT)
    model = train(split.filter(F.col("split") == "train"), LINE_SPEC, LINE_MODEL)
    return model, score(model, split, LINE_MODEL)


def fitted_sql(rows: str, key: str, numeric: list[str], categories: dict[str, list[str]], steps: int = 14) -> str:
    """CTEs from rows with ``label`` and a key to ``fitted``: their split and the probability of a trained model.

    Splits, medians, modes and scaling as the library defines them; then Newton
    steps on the penalized, class-balanced objective. The Hessian and the gradient
    of a step are one flat list, solved by elimination in a recursion over pivots.
    """
    hot = [(c, v) for c, values in categories.items() for v in values]
    size = len(numeric) + len(hot) + 1
    wide, columns = size + 1, range(1, size + 1)
    medians = ", ".join(f"median({n}) AS md_{n}" for n in numeric)
    modes_of = ", ".join(
        f"(SELECT {c} FROM tr WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1) AS mo_{c}"
        for c in categories)
    filled = ", ".join([f"coalesce({n}, md_{n}) AS f_{n}" for n in numeric]
                       + [f"coalesce({c}, mo_{c}) AS f_{c}" for c in categories])
    moments = ", ".join(f"avg(f_{n}) AS a_{n}, stddev_pop(f_{n}) AS s_{n}" for n in numeric)
    cells = [f"(f_{n} - a_{n}) / CASE WHEN s_{n} > 0 THEN s_{n} ELSE 1 END" for n in numeric]
    cells += [f"CAST(f_{c} = '{v}' AS DOUBLE)" for c, v in hot] + ["CAST(1 AS DOUBLE)"]
    design = ", ".join(f"{c} AS x{i}" for i, c in zip(columns, cells))
    line = " + ".join(f"beta[{i}] * x{i}" for i in columns)
    sums = ", ".join(f"sum(v * x{i} * x{j}) AS h{i}_{j}" for i in columns for j in columns if i <= j)
    flat = ", ".join(
        ", ".join([f"h{min(i, j)}_{max(i, j)}" + (" + 1" if i == j < size else "") for j in columns]
                  + [f"u{i}" + (f" - beta[{i}]" if i < size else "")])
        for i in columns)
    text = f"""
    o AS ({rows}), counts AS (SELECT label, count(*) AS n FROM o GROUP BY 1), {quotas_sql('0.2', '0.1')},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || {key}), {key}) AS rn FROM o),
    sp AS (SELECT r.*, CASE WHEN rn <= test THEN 'test' WHEN rn <= test + validation THEN 'validation'
                            ELSE 'train' END AS split FROM ranked r JOIN quotas z ON z.label = r.label),
    tr AS (SELECT * FROM sp WHERE split = 'train'),
    im AS (SELECT sp.*, {filled} FROM sp, (SELECT {medians} FROM tr), (SELECT {modes_of})),
    st AS (SELECT {moments}, count(*) AS total, sum(label) AS positive FROM im WHERE split = 'train'),
    dm AS MATERIALIZED (SELECT im.*, {design}, CASE WHEN label = 1 THEN total / (2 * positive)
                               ELSE total / (2 * (total - positive)) END AS wt FROM im, st),
    b0 AS (SELECT [CAST(0 AS DOUBLE) FOR t IN range({size})] AS beta)"""
    for k in range(steps):
        text += f""",
    g{k} AS MATERIALIZED (
      SELECT any_value(beta) AS beta, {sums}, {", ".join(f"sum(u * x{i}) AS u{i}" for i in columns)}
      FROM (SELECT *, wt * p * (1 - p) AS v, wt * (label - p) AS u
            FROM (SELECT *, 1 / (1 + exp(-({line}))) AS p FROM dm, b{k} WHERE split = 'train'))),
    e{k}(i, beta, m) AS (
      SELECT 0, beta, [{flat}] FROM g{k}
      UNION ALL
      SELECT i + 1, beta, [CASE WHEN t // {wide} = i THEN m[t + 1] / m[i * {wide} + i + 1]
          ELSE m[t + 1] - m[(t // {wide}) * {wide} + i + 1] * m[i * {wide} + t % {wide} + 1] / m[i * {wide} + i + 1]
          END FOR t IN range({size * wide})] FROM e{k} WHERE i < {size}),
    b{k + 1} AS MATERIALIZED (
      SELECT [beta[t] + m[t * {wide}] FOR t IN range(1, {size + 1})] AS beta FROM e{k} WHERE i = {size})"""
    return text + f""",
    fitted AS (SELECT dm.*, 1 / (1 + exp(-({line}))) AS p FROM dm, b{steps})"""


_LINES_SQL = "WITH RECURSIVE " + fitted_sql(
    """SELECT *, CASE WHEN l_tax > 0 THEN l_extendedprice END AS price, l_quantity AS quantity,
              l_discount AS discount, l_tax AS tax, l_linestatus AS line_status,
              CASE WHEN l_returnflag <> 'A' THEN CAST(month(l_shipdate) AS VARCHAR) END AS ship_month,
              CAST(l_extendedprice * (1 - l_discount) > 45000 AS INT) AS label,
              concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'),
                        CAST(floor(l_quantity * 100) AS BIGINT), CAST(floor(l_extendedprice * 100) AS BIGINT),
                        CAST(floor(l_discount * 100) AS BIGINT), CAST(floor(l_tax * 100) AS BIGINT)) AS row_key
       FROM lineitem""",
    "row_key", ["quantity", "price", "discount", "tax"],
    {"line_status": ["F", "O"], "ship_month": [str(m) for m in range(1, 13)]},
)


@query(
    "train_score",
    _LINES_SQL
    + """SELECT row_key, split, label, CAST(p > 0.5 AS INT) AS predicted_class, p > 0.5 AS predicted_positive,
                round(p, 5) AS probability, CAST(0.4 AS DOUBLE) AS decision_threshold FROM fitted""",
)
def train_score(spark, sf):
    """A model of six features, to the digits an independent solution gives."""
    _, scored = trained_lines(spark, sf)
    return scored.select(
        "row_key", "split", "label", "predicted_class", "predicted_positive",
        F.round("probability", 5).alias("probability"), "decision_threshold",
    )


@query(
    "trained_metrics",
    _LINES_SQL
    + ", q AS (SELECT split, label AS y, round(p, 7) AS score, CAST(p > 0.5 AS INT) AS p FROM fitted),"
    + _METRICS + _LONG,
)
def trained_metrics(spark, sf):
    _, scored = trained_lines(spark, sf)
    ranked = scored.withColumn("probability", F.round("probability", 7))
    return metrics_long(_rounded(classification_metrics(ranked), (*_RATIOS, *_RANKS)))


@query(
    "prediction_rows",
    _LINES_SQL
    + """SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY row_key) - 1 AS index,
                CAST(p > 0.5 AS INT) AS predicted_class, p > 0.5 AS predicted_positive, round(p, 5) AS probability,
                CAST(0.4 AS DOUBLE) AS decision_threshold, 'logistic_regression' AS model_name,
                'run_table' AS source_type, '20240101T000000000000Z' AS training_run_id FROM fitted""",
)
def prediction_rows_query(spark, sf):
    _, scored = trained_lines(spark, sf)
    reference = {"model_name": "logistic_regression", "source_type": "run_table",
                 "training_run_id": "20240101T000000000000Z"}
    rows = prediction_rows(scored, "l_suppkey", "row_key", reference)
    return rows.withColumn("probability", F.round("probability", 5)).select("*", "model.*").drop("model")


@query(
    "document_quality_model",
    "WITH RECURSIVE " + fitted_sql(
        """SELECT doc_id, quality AS label, CAST(n_chars AS DOUBLE) AS n_chars, lang, source
           FROM labels JOIN documents USING (doc_id)""",
        "doc_id", ["n_chars"], {"lang": ["de", "en", "es", "fr"], "source": [f"src{i}" for i in range(20)]},
    )
    + """SELECT doc_id, split, label, CAST(p > 0.5 AS INT) AS predicted_class, round(p, 5) AS probability
         FROM fitted""",
)
def document_quality_model(spark, sf):
    """Quality of documents from their length, language and source."""
    labelled = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    prepared = labelled.select(
        "doc_id", F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("n_chars"),
        "lang", "source",
    )
    split = assign_splits(prepared, "label", "doc_id", SPLIT)
    options = ModelOptions(solver="newton")
    model = train(split.filter(F.col("split") == "train"), FeatureSpec(("n_chars",), ("lang", "source")), options)
    return score(model, split, options).select(
        "doc_id", "split", "label", "predicted_class", F.round("probability", 5).alias("probability")
    )


_NEWTON_SQL = """
    WITH RECURSIVE y AS (
      SELECT l_quantity, CAST(l_extendedprice * (1 - l_discount) > 45000 AS INT) AS y FROM lineitem),
    s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd, CAST(count(*) AS DOUBLE) AS total,
                 CAST(sum(y) AS DOUBLE) AS positive FROM y),
    g AS (SELECT l_quantity, (l_quantity - any_value(m)) / any_value(sd) AS z, count(*) AS row_count,
                 sum(y) AS positives,
                 sum(y) * any_value(total) / (2 * any_value(positive)) AS a,
                 sum(1 - y) * any_value(total) / (2 * (any_value(total) - any_value(positive))) AS b
          FROM y, s GROUP BY l_quantity),
    n AS (
      SELECT 0 AS i, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1
      UNION ALL
      SELECT i + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01),
             b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
      FROM (SELECT i, b0, b1, sum((a + b) * p - a) AS g0, sum(((a + b) * p - a) * z) + b1 AS g1,
                   sum((a + b) * p * (1 - p)) AS h00, sum((a + b) * p * (1 - p) * z) AS h01,
                   sum((a + b) * p * (1 - p) * z * z) + 1 AS h11
            FROM (SELECT i, b0, b1, a, b, z, 1 / (1 + exp(-(b0 + b1 * z))) AS p FROM n, g) GROUP BY i, b0, b1)
      WHERE i < 25),
    f AS (SELECT l_quantity, row_count, positives, 1 / (1 + exp(-(b0 + b1 * z))) AS p FROM g, n WHERE i = 25)
"""


def _quantity_model(spark, sf):
    """A classifier of one feature, which SQL can solve by Newton steps."""
    lines = _returned_lines(spark, sf).select("l_quantity", "label")
    options = ModelOptions(tol=1e-10)
    return score(train(lines, FeatureSpec(("l_quantity",), ()), options), lines, options)


@query(
    "trained_probabilities",
    _NEWTON_SQL
    + """SELECT l_quantity, row_count, round(p, 3) AS probability, CAST(p > 0.5 AS INT) AS predicted_class FROM f""",
)
def trained_probabilities(spark, sf):
    scored = _quantity_model(spark, sf)
    return scored.groupBy("l_quantity", "predicted_class").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.max("probability"), 3).alias("probability")
    )


@query(
    "trained_confusion",
    _NEWTON_SQL
    + """, c AS (SELECT sum(row_count) AS n, sum(positives) FILTER (p > 0.5) AS tp,
                        sum(row_count - positives) FILTER (p > 0.5) AS fp,
                        sum(positives) FILTER (p <= 0.5) AS fn, sum(row_count - positives) FILTER (p <= 0.5) AS tn FROM f)
         SELECT 'all' AS split, CAST(n AS BIGINT) AS support, CAST(tn AS BIGINT) AS true_negatives,
                CAST(fp AS BIGINT) AS false_positives, CAST(fn AS BIGINT) AS false_negatives,
                CAST(tp AS BIGINT) AS true_positives, round((tp + tn) / n, 9) AS accuracy,
                round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall,
                round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""",
)
def trained_confusion(spark, sf):
    scored = _quantity_model(spark, sf).withColumn("split", F.lit("all"))
    return _rounded(confusion_metrics(scored, ["split"]), _RATIOS)
