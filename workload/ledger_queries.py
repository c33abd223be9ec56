"""Run ledger, promotion, model resolution, stage outputs and run bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import feature_list, negative_label
from tidemark.operators import ledger as lg
from tidemark.operators.baseline import build_baseline
from tidemark.operators.contract import contract_report
from tidemark.operators.evaluate import confusion_metrics, metrics_long
from tidemark.operators.model import score, train
from tidemark.operators.splits import assign_splits, split_sizes
from tidemark.options import DatasetOptions, DriftOptions, FeatureSpec, ModelOptions, RegistryOptions, SplitOptions
from tidemark.session import new_folder
from tidemark.sources.delimited import load_dataset
from tidemark.sources.store import RunStore, files_key
from workload import query, table
from workload.model_queries import (
    _NEWTON_SQL,
    _RATIOS,
    _SCORED_SQL,
    _SPLIT_SQL,
    _labelled_orders,
    _returned_lines,
    confusion_metrics_query,
)

REGISTRY = RegistryOptions(metric="f1", split="validation", alias="live")


def runs(spark, sf):
    """Suppliers as training runs of their nation's model, in key order."""
    s = table(spark, sf, "supplier")
    return s.select(
        _run_id("s_suppkey").alias("run_id"),
        F.concat(F.lit("model_"), F.col("s_nationkey").cast("string")).alias("model_name"),
        F.col("s_suppkey").alias("run_no"), "s_acctbal",
    )


def _run_id(column):
    return F.concat(F.lit("r"), F.lpad(F.col(column).cast("string"), 9, "0"))


def run_metrics(spark, sf):
    """Line items of a supplier as its metrics: return flags are splits."""
    line = table(spark, sf, "lineitem")
    wide = line.groupBy(
        _run_id("l_suppkey").alias("run_id"),
        F.when(F.col("l_returnflag") == "A", "train").when(F.col("l_returnflag") == "N", "test")
        .otherwise("validation").alias("split"),
    ).agg(
        F.when(F.count(F.lit(1)) > 2, F.max("l_extendedprice") - F.min("l_extendedprice")).alias("f1"),
        F.max("l_quantity").alias("recall"),
        F.count(F.lit(1)).cast("double").alias("support"),
    )
    return wide.unpivot(["run_id", "split"], ["f1", "recall", "support"], "metric", "value")


_RUNS = """
    runs AS (SELECT 'r' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS run_id, 'model_' || s_nationkey AS model_name,
                    s_suppkey AS run_no, s_acctbal FROM supplier),
    wide AS (SELECT 'r' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS run_id,
               CASE l_returnflag WHEN 'A' THEN 'train' WHEN 'N' THEN 'test' ELSE 'validation' END AS split,
               CASE WHEN count(*) > 2 THEN max(l_extendedprice) - min(l_extendedprice) END AS f1,
               max(l_quantity) AS recall, CAST(count(*) AS DOUBLE) AS support FROM lineitem GROUP BY 1, 2),
    metrics AS (SELECT run_id, split, 'f1' AS metric, f1 AS value FROM wide
                UNION ALL SELECT run_id, split, 'recall', recall FROM wide
                UNION ALL SELECT run_id, split, 'support', support FROM wide),
    cand AS (SELECT r.*, m.value AS candidate_metric FROM runs r LEFT JOIN metrics m
             ON m.run_id = r.run_id AND m.split = 'validation' AND m.metric = 'f1')
"""


@query(
    "ledger_params",
    """
    WITH s AS (SELECT 'r' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS run_id, * FROM supplier)
    SELECT run_id, 'data.name' AS key, s_name AS value FROM s
    UNION ALL SELECT run_id, 'data.rows', CAST(s_suppkey AS VARCHAR) FROM s
    UNION ALL SELECT run_id, 'model.param.nation', CAST(s_nationkey AS VARCHAR) FROM s
    UNION ALL SELECT run_id, 'model.param.key', CAST(s_suppkey AS VARCHAR) FROM s
    UNION ALL SELECT run_id, 'model.name', 'logistic_regression' FROM s
    UNION ALL SELECT run_id, 'tags.owner', s_name FROM s WHERE s_acctbal > 0
    """,
)
def ledger_params(spark, sf):
    s = table(spark, sf, "supplier")
    nested = s.select(
        _run_id("s_suppkey").alias("run_id"),
        F.struct(F.col("s_name").alias("name"), F.col("s_suppkey").alias("rows")).alias("data"),
        F.struct(
            F.lit("logistic_regression").alias("name"),
            F.create_map(
                F.lit("nation"), F.col("s_nationkey").cast("string"),
                F.lit("key"), F.col("s_suppkey").cast("string"),
            ).alias("param"),
        ).alias("model"),
        F.struct(F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("owner")).alias("tags"),
    )
    return lg.flatten_settings(nested)


@query(
    "ledger_metrics",
    f"WITH {_RUNS} SELECT run_id, split || '_' || metric AS key, round(value, 6) AS value FROM metrics WHERE value IS NOT NULL",
)
def ledger_metrics(spark, sf):
    return lg.flatten_metrics(run_metrics(spark, sf)).withColumn("value", F.round("value", 6))


@query(
    "split_metrics_flat",
    _SCORED_SQL
    + " UNION ALL ".join(
        f"SELECT 'r1' AS run_id, split || '_{n}' AS key, {n} AS value FROM m" for n in _RATIOS
    ),
)
def split_metrics_flat(spark, sf):
    wide = confusion_metrics_query(spark, sf).withColumn("run_id", F.lit("r1"))
    long = wide.unpivot(["run_id", "split"], list(_RATIOS), "metric", "value")
    return lg.flatten_metrics(long)


@query(
    "candidate_metrics",
    f"WITH {_RUNS} SELECT run_id, model_name, round(candidate_metric, 6) AS candidate_metric FROM cand",
)
def candidate_metrics(spark, sf):
    found = lg.candidate_metrics(runs(spark, sf), run_metrics(spark, sf), REGISTRY)
    return found.select("run_id", "model_name", F.round("candidate_metric", 6).alias("candidate_metric"))


def _candidates(spark, sf):
    return lg.candidate_metrics(runs(spark, sf), run_metrics(spark, sf), REGISTRY)


def versions(spark, sf):
    """Runs with a positive balance are registered; some carry tags for another metric."""
    registered = runs(spark, sf).filter(F.col("s_acctbal") > 0)
    own = F.col("run_no") % 2 == 0
    return registered.select(
        "model_name", F.col("run_no").alias("version"), "run_id",
        F.when(own, "f1").otherwise("recall").alias("metric_name"),
        F.lit("validation").alias("metric_split"),
        F.col("s_acctbal").cast("string").alias("candidate_metric"),
    )


_VERSIONS = f"""{_RUNS},
    versions AS (SELECT model_name, run_no AS version, r.run_id,
                   CASE WHEN run_no % 2 = 0 THEN s_acctbal ELSE m.value END AS incumbent_metric
                 FROM runs r LEFT JOIN metrics m ON m.run_id = r.run_id AND m.split = 'validation' AND m.metric = 'f1'
                 WHERE s_acctbal > 0),
    scored AS (SELECT * FROM versions WHERE incumbent_metric IS NOT NULL),
    pick AS (SELECT c.run_id, c.model_name, c.candidate_metric, v.version AS incumbent_version, v.incumbent_metric
             FROM cand c LEFT JOIN scored v ON v.model_name = c.model_name AND v.run_id <> c.run_id
             QUALIFY row_number() OVER (PARTITION BY c.run_id ORDER BY v.incumbent_metric DESC, v.version) = 1),
    promoted AS (SELECT *, CASE WHEN candidate_metric IS NULL THEN 'metric_unavailable'
                    WHEN incumbent_metric IS NOT NULL AND NOT candidate_metric > incumbent_metric THEN 'not_best'
                    ELSE 'registered' END AS status FROM pick)
"""


@query(
    "incumbent_metrics",
    f"WITH {_VERSIONS} SELECT model_name, version, run_id, round(incumbent_metric, 6) AS incumbent_metric FROM scored",
)
def incumbent_metrics(spark, sf):
    found = lg.version_metrics(versions(spark, sf), run_metrics(spark, sf), REGISTRY)
    return found.withColumn("incumbent_metric", F.round("incumbent_metric", 6))


def _promoted(spark, sf):
    scored = lg.version_metrics(versions(spark, sf), run_metrics(spark, sf), REGISTRY)
    return lg.promotion_status(lg.best_incumbents(scored, _candidates(spark, sf), REGISTRY), REGISTRY)


@query(
    "promotion_status",
    f"""WITH {_VERSIONS} SELECT run_id, model_name, round(candidate_metric, 6) AS candidate_metric,
          round(incumbent_metric, 6) AS incumbent_metric, incumbent_version, status, status = 'registered' AS registered
        FROM promoted""",
)
def promotion_status(spark, sf):
    return _promoted(spark, sf).select(
        "run_id", "model_name", F.round("candidate_metric", 6).alias("candidate_metric"),
        F.round("incumbent_metric", 6).alias("incumbent_metric"), "incumbent_version", "status", "registered",
    )


_HISTORY = f"""WITH {_RUNS},
    best AS (SELECT *, max(candidate_metric) OVER (PARTITION BY model_name ORDER BY run_no
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS incumbent_metric FROM cand),
    st AS (SELECT *, CASE WHEN candidate_metric IS NULL THEN 'metric_unavailable'
                    WHEN incumbent_metric IS NOT NULL AND NOT candidate_metric > incumbent_metric THEN 'not_best'
                    ELSE 'registered' END AS status FROM best),
    hist AS (SELECT *, CAST(sum(CASE WHEN status = 'registered' THEN 1 ELSE 0 END)
                       OVER (PARTITION BY model_name ORDER BY run_no) AS BIGINT) AS versions FROM st)
"""


@query(
    "promotion_history",
    _HISTORY
    + """SELECT run_id, model_name, status, round(candidate_metric, 6) AS candidate_metric,
                round(incumbent_metric, 6) AS incumbent_metric,
                CASE WHEN status = 'registered' THEN versions END AS version,
                CASE WHEN incumbent_metric IS NOT NULL
                     THEN versions - CASE WHEN status = 'registered' THEN 1 ELSE 0 END END AS incumbent_version
         FROM hist""",
)
def promotion_history(spark, sf):
    return _history_rows(lg.promotion_history(_candidates(spark, sf), "run_no", REGISTRY))


def _history_rows(history):
    return history.select(
        "run_id", "model_name", "status", F.round("candidate_metric", 6).alias("candidate_metric"),
        F.round("incumbent_metric", 6).alias("incumbent_metric"), "version", "incumbent_version",
    )


def _registered(spark, sf):
    """Version table a full replay leaves behind."""
    history = lg.promotion_history(_candidates(spark, sf), "run_no", REGISTRY)
    return history.filter("registered").select("model_name", "version", "run_id")


_REGISTERED = _HISTORY + ", reg AS (SELECT model_name, versions AS version, run_id FROM hist WHERE status = 'registered')"


@query(
    "model_aliases",
    _REGISTERED
    + """SELECT model_name, 'live' AS alias, max(version) AS version FROM reg GROUP BY 1
         UNION ALL SELECT model_name, 'first', min(version) FROM reg GROUP BY 1""",
)
def model_aliases(spark, sf):
    return _aliases(_registered(spark, sf))


def _aliases(registered):
    """Aliases after the newest version of each model took over ``live``."""
    first = registered.groupBy("model_name").agg(F.min("version").alias("version"))
    old = first.select("model_name", F.explode(F.array(F.lit("live"), F.lit("first"))).alias("alias"), "version")
    newest = registered.groupBy("model_name").agg(F.max("version").alias("version"))
    return lg.upsert_aliases(old, lg.alias_rows(newest, REGISTRY))


@query(
    "new_versions",
    f"""WITH {_VERSIONS}, last AS (SELECT model_name, max(version) AS v FROM versions GROUP BY 1),
        best AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY run_id) AS place
                 FROM promoted WHERE status = 'registered')
    SELECT b.model_name, coalesce(v, 0) + place AS version, run_id, 'f1' AS metric_name, 'validation' AS metric_split,
           round(candidate_metric, 6) AS candidate_metric
    FROM best b LEFT JOIN last l ON l.model_name = b.model_name""",
)
def new_versions(spark, sf):
    """All promoted runs of a model become its next versions, one after the other."""
    return lg.new_versions(_promoted(spark, sf), versions(spark, sf), REGISTRY).withColumn(
        "candidate_metric", F.round("candidate_metric", 6)
    )


@query(
    "resolve_model",
    _REGISTERED
    + """, al AS (SELECT model_name, 'live' AS alias, max(version) AS version FROM reg GROUP BY 1
                  UNION ALL SELECT model_name, 'first', min(version) FROM reg GROUP BY 1),
         rq AS (SELECT DISTINCT model_name, 'live' AS alias, CAST(NULL AS BIGINT) AS pinned_version FROM runs
                UNION ALL SELECT DISTINCT model_name, 'absent', CAST(NULL AS BIGINT) FROM runs
                UNION ALL SELECT DISTINCT model_name, NULL, CAST(2 AS BIGINT) FROM runs
                UNION ALL SELECT DISTINCT model_name, NULL, CAST(1000000 AS BIGINT) FROM runs)
         SELECT rq.model_name, rq.alias, rq.pinned_version, reg.version, reg.run_id,
                CASE WHEN reg.version IS NOT NULL THEN
                  'models:/' || rq.model_name || CASE WHEN rq.alias IS NOT NULL THEN '@' || rq.alias
                  ELSE '/' || rq.pinned_version END END AS model_uri,
                reg.version IS NOT NULL AS found
         FROM rq LEFT JOIN al ON al.model_name = rq.model_name AND al.alias = rq.alias
         LEFT JOIN reg ON reg.model_name = rq.model_name AND reg.version = coalesce(rq.pinned_version, al.version)""",
)
def resolve_model(spark, sf):
    """Requests by alias and by version; some name nothing that is registered."""
    registered = _registered(spark, sf)
    names = runs(spark, sf).select("model_name").distinct()
    kinds = F.explode(
        F.array(
            F.struct(F.lit("live").alias("alias"), F.lit(None).cast("bigint").alias("pinned_version")),
            F.struct(F.lit("absent").alias("alias"), F.lit(None).cast("bigint").alias("pinned_version")),
            F.struct(F.lit(None).cast("string").alias("alias"), F.lit(2).cast("bigint").alias("pinned_version")),
            F.struct(F.lit(None).cast("string").alias("alias"), F.lit(1000000).cast("bigint").alias("pinned_version")),
        )
    )
    requests = names.withColumn("r", kinds).select("model_name", "r.*")
    return lg.resolve_models(requests, registered, _aliases(registered), strict=False)


def _models(spark, sf):
    return runs(spark, sf).filter(F.col("s_acctbal") > 5000).select(
        "run_id", F.concat(F.lit("runs/"), F.col("run_id"), F.lit("/model")).alias("model_path")
    )


@query(
    "latest_run",
    f"""WITH {_RUNS} SELECT max(run_id) AS run_id, 'runs/' || max(run_id) || '/model' AS model_path
        FROM runs WHERE s_acctbal > 5000""",
)
def latest_run(spark, sf):
    return lg.latest_run(runs(spark, sf), _models(spark, sf))


@query(
    "baseline_lookup",
    """
    WITH k AS (SELECT DISTINCT s_nationkey AS nation FROM supplier),
    b AS (SELECT c_nationkey AS nation, count(*) AS sample_size, max(c_acctbal) AS max_value FROM customer
          WHERE c_nationkey < 15 GROUP BY 1),
    t AS (SELECT c_nationkey AS nation, count(*) AS sample_size, min(c_acctbal) AS max_value FROM customer
          WHERE c_nationkey BETWEEN 10 AND 19 GROUP BY 1)
    SELECT 'run_' || k.nation AS monitor_key, CASE WHEN b.nation IS NULL THEN t.sample_size ELSE b.sample_size END AS sample_size,
           CASE WHEN b.nation IS NULL THEN t.max_value ELSE b.max_value END AS max_value,
           CASE WHEN b.nation IS NOT NULL THEN 'local' WHEN t.nation IS NOT NULL THEN 'tracked' END AS baseline_source
    FROM k LEFT JOIN b ON b.nation = k.nation LEFT JOIN t ON t.nation = k.nation
    """,
)
def baseline_lookup(spark, sf):
    """Local baselines first, then tracked ones, then none."""
    key = F.concat(F.lit("run_"), F.col("nation").cast("string"))
    models = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")).distinct()
    customer = table(spark, sf, "customer").withColumn("nation", F.col("c_nationkey"))

    def stats(rows, value):
        found = rows.groupBy("nation").agg(F.count(F.lit(1)).alias("sample_size"), value.alias("max_value"))
        return found.select(key.alias("monitor_key"), "sample_size", "max_value")

    return lg.baseline_for_models(
        models.select(key.alias("monitor_key")),
        stats(customer.filter("nation < 15"), F.max("c_acctbal")), ["monitor_key"],
        stats(customer.filter("nation BETWEEN 10 AND 19"), F.min("c_acctbal")),
    )


@query(
    "label_pair",
    f"""WITH {_RUNS}, d AS (SELECT run_id, list_sort(list(DISTINCT split)) AS classes FROM wide GROUP BY 1)
    SELECT r.run_id, list_filter(classes, lambda x: x <> 'test')[1] AS negative_label,
           CASE WHEN s_acctbal > 0 THEN array_to_string(classes, ',') ELSE 'tenure' END AS features
    FROM runs r LEFT JOIN d ON d.run_id = r.run_id""",
)
def label_pair(spark, sf):
    # a run has at most three splits
    classes = run_metrics(spark, sf).groupBy("run_id").agg(
        F.array_sort(F.collect_set("split")).alias("classes")
    )
    joined = runs(spark, sf).join(classes, "run_id", "left")
    recorded = F.when(F.col("s_acctbal") > 0, F.col("classes"))
    return joined.select(
        "run_id", negative_label("classes", "test").alias("negative_label"),
        F.array_join(feature_list(recorded, ["tenure"]), ",").alias("features"),
    )


DATASET = DatasetOptions(
    target="o_orderstatus", positive_class="F", id_columns=("o_orderkey",), drop_columns=("o_custkey",),
    numeric_features=("o_totalprice",), categorical_features=("o_orderpriority",),
)
SPLIT = SplitOptions(test_size=0.2, validation_size=0.1, seed=42)


@query(
    "stage_summary",
    _SPLIT_SQL
    + """SELECT 'ingestion' AS stage, 6 AS column_count, (SELECT count(*) FROM orders) AS row_count,
                'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns
         UNION ALL SELECT 'preprocessing', 3, (SELECT count(*) FROM s), 'o_orderkey,label,split'
         UNION ALL SELECT 'evaluation', 2, (SELECT count(DISTINCT split) FROM s), 'split,row_count'""",
)
def stage_summary(spark, sf):
    """Three stages, each built on what the stage before wrote, run twice."""
    store, run_id = RunStore(spark, new_folder(spark, "stages")), "20240101T000000000000Z"
    for _ in range(2):
        raw = store.stage("ingestion", run_id, lambda: table(spark, sf, "orders"))
        split = store.stage(
            "preprocessing", run_id,
            lambda: assign_splits(
                raw.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("label")),
                "label", "o_orderkey", SPLIT,
            ),
        )
        sizes = store.stage("evaluation", run_id, lambda: split_sizes(split))
    parts = [
        store.summarize_stage(name, run_id, df)
        for name, df in (("ingestion", raw), ("preprocessing", split), ("evaluation", sizes))
    ]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.select("stage", "column_count", "row_count", F.array_join("columns", ",").alias("columns"))


@query(
    "stage_reuse",
    _SPLIT_SQL
    + """, z AS (SELECT count(*) AS n, count(*) FILTER (split = 'test') AS test,
                        count(*) FILTER (split = 'validation') AS validation FROM s),
         w AS (SELECT CAST(1 AS INT) AS run, true AS built UNION ALL SELECT 2, false UNION ALL SELECT 3, true)
         SELECT run, 'ingestion' AS stage, run = 1 AS built, n AS row_count, NULL::BIGINT AS test_rows,
                NULL AS numeric_features FROM w, z
         UNION ALL SELECT run, 'preprocessing', built, n,
                CASE WHEN run < 3 THEN test ELSE CAST(ceil(n * CAST(0.3 AS DOUBLE)) AS BIGINT) END, 'o_totalprice'
         FROM w, z""",
)
def stage_reuse(spark, sf):
    """Stages run three times, the last time with a larger test split: what has not changed is read, not built."""
    store, run_id = RunStore(spark, new_folder(spark, "stages")), "20240101T000000000000Z"
    found = None
    for run, options in ((1, SPLIT), (2, SPLIT), (3, SplitOptions(test_size=0.3, validation_size=0.1, seed=42))):
        built = []

        def build(stage, rows):
            built.append(stage)
            return rows

        raw = store.stage(
            "ingestion", run_id, lambda: build("ingestion", _labelled_orders(spark, sf)),
            [files_key(spark, f"{sf}/orders.parquet")])
        split = store.stage(
            "preprocessing", run_id, lambda: build("preprocessing", assign_splits(raw, "label", "o_orderkey", options)),
            [store.stage_key("ingestion", run_id)], options)
        parts = [
            store.summarize_stage("ingestion", f"{run_id}-{run}", raw),
            store.summarize_stage("preprocessing", f"{run_id}-{run}", split, "split", FeatureSpec(("o_totalprice",))),
        ]
        for part in parts:
            row = part.select(
                F.lit(run).alias("run"), "stage", F.col("stage").isin(*built).alias("built"), "row_count",
                F.col("split_sizes")["test"].alias("test_rows"),
                F.array_join("numeric_features", ",").alias("numeric_features"))
            found = row if found is None else found.unionByName(row)
    return found


@query(
    "bundle_model",
    _NEWTON_SQL
    + """, c AS (SELECT sum(row_count) AS n, sum(positives) FILTER (p > 0.5) AS tp,
                        sum(row_count - positives) FILTER (p <= 0.5) AS tn FROM f)
         SELECT '20240101T000000000000Z' AS run_id, l_quantity, row_count, round(p, 6) AS probability,
                CAST(p > 0.5 AS INT) AS predicted_class, round((tp + tn) / n, 9) AS accuracy FROM f, c""",
)
def bundle_model(spark, sf):
    """A published model is read back and scores; so are its metrics. Training again finds the model."""
    store, run_id = RunStore(spark, new_folder(spark, "bundle")), "20240101T000000000000Z"
    options, spec = ModelOptions(solver="newton"), FeatureSpec(("l_quantity",))
    lines = _returned_lines(spark, sf).select("l_quantity", "label")
    inputs = [files_key(spark, f"{sf}/lineitem.parquet")]
    for _ in range(2):
        model = store.model_stage(run_id, lambda: train(lines, spec, options), inputs, options)
    scored = score(model, lines, options).withColumn("split", F.lit("all"))
    store.write_bundle(
        run_id,
        baseline=build_baseline(lines, spec, DriftOptions()),
        metrics=metrics_long(confusion_metrics(scored, ["split"])),
        report=contract_report(lines, DatasetOptions(target="label", positive_class="1")),
        split_sizes=split_sizes(scored),
        settings={"model": options},
        generated_at="2024-01-01T00:00:00+00:00",
        model=model,
    )
    accuracy = store.read("metrics").filter("metric = 'accuracy'").select(
        "run_id", F.round("value", 9).alias("accuracy"))
    again = score(store.load_model(run_id), lines, options).groupBy("l_quantity", "predicted_class").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.max("probability"), 6).alias("probability"))
    published = store.read("runs").select("run_id").join(accuracy, "run_id")  # one row
    return again.withColumn("run_id", F.lit(run_id)).join(F.broadcast(published), "run_id")


@query(
    "bundle_roundtrip",
    """
    WITH b AS (SELECT count(*) AS n FROM orders)
    SELECT '20240101T000000000000Z' AS run_id, n AS baseline_sample_size, CAST(2 AS BIGINT) AS baseline_feature_count,
           'o_totalprice' AS numeric_features, 'o_orderpriority' AS categorical_features, n AS reported_rows,
           CAST(18 AS BIGINT) AS buckets, '0.2' AS test_size, CAST(3 AS BIGINT) AS splits
    FROM b
    """,
)
def bundle_roundtrip(spark, sf):
    """Publish a run and read every part of it back."""
    store, run_id = RunStore(spark, new_folder(spark, "bundle")), "20240101T000000000000Z"
    orders, report = load_dataset(spark, f"{sf}/orders.parquet", DATASET, kind="parquet")
    split = assign_splits(_labelled_orders(spark, sf), "label", "o_orderkey", SPLIT)
    store.write_bundle(
        run_id,
        baseline=build_baseline(orders, FeatureSpec(("o_totalprice",), ("o_orderpriority",)), DriftOptions()),
        metrics=confusion_metrics_query(spark, sf),
        report=report,
        split_sizes=split_sizes(split),
        settings={"split": SPLIT, "data": {"target": DATASET.target}},
        generated_at="2024-01-01T00:00:00+00:00",
    )
    row = store.read("runs")
    reports = store.read("reports").select("run_id", F.col("row_count").alias("reported_rows"))
    buckets = store.read("baselines").groupBy("run_id").agg(
        F.sum(F.size("expected_distribution")).alias("buckets")
    )
    settings = store.read("settings").filter(F.col("key") == "split.test_size").select(
        "run_id", F.col("value").alias("test_size")
    )
    splits = store.read("split_sizes").groupBy("run_id").agg(F.count(F.lit(1)).alias("splits"))
    joined = row
    for part in (reports, buckets, settings, splits):
        joined = joined.join(part, "run_id")
    return joined.select(
        "run_id", "baseline_sample_size", "baseline_feature_count",
        F.array_join("numeric_features", ",").alias("numeric_features"),
        F.array_join("categorical_features", ",").alias("categorical_features"),
        "reported_rows", "buckets", "test_size", "splits",
    )


@query(
    "csv_roundtrip",
    """
    SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice,
           CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS priority,
           o_totalprice > 250000 AS large
    FROM orders
    """,
)
def csv_roundtrip(spark, sf):
    """Orders written as delimited text with odd headers and missing tokens, then read back."""
    folder = new_folder(spark, "csv")
    orders = table(spark, sf, "orders")
    text = orders.select(
        F.col("o_orderkey").alias(" o_orderkey"),
        F.col("o_orderstatus").alias("Order Status "),
        F.format_string("%.2f", "o_totalprice").alias("o_totalprice"),
        F.when(F.col("o_orderpriority") == "5-LOW", "n/a").otherwise(F.col("o_orderpriority"))
        .alias("o_orderpriority"),
        F.when(F.col("o_totalprice") > 250000, "True").otherwise("False").alias("large"),
    )
    text.write.option("header", True).csv(folder)
    options = DatasetOptions(
        target="o_orderstatus", positive_class="F", id_columns=("o_orderkey",),
        renames={"Order Status": "o_orderstatus", "o_orderpriority": "priority", "Absent": "x"},
        numeric_features=("o_totalprice",), categorical_features=("priority",), na_values=("", " "),
    )
    df, _ = load_dataset(spark, folder, options)
    return df


@query(
    "validated_report_table",
    "SELECT CAST(count(*) AS BIGINT) AS row_count, 6 AS column_count FROM orders",
)
def validated_report_table(spark, sf):
    return contract_report(table(spark, sf, "orders"), DATASET).select("row_count", "column_count")
