"""Baselines, distributions and drift reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.baseline import (
    baseline_from_json,
    baseline_to_json,
    build_baseline,
    category_counts,
    category_profile,
    cut_points,
    numeric_profile,
)
from tidemark.operators.drift import drift_evaluation, drift_features
from tidemark.options import DriftOptions, FeatureSpec
from tidemark.plans.local import small_table
from workload import query, table

OPTIONS = DriftOptions()
LINE_NUMERICS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
SPEC = FeatureSpec(("value", "k"), ("event_type",))


def edges_sql(source: str, column: str, bins: int) -> str:
    """CTE body: inner quantile edges of a column as a sorted list ``cuts``.

    Ranks are whole numbers, values between two ranks are interpolated; equal
    edges collapse before the outer two are dropped.
    """
    return f"""
      SELECT list_distinct_sorted[2:len(list_distinct_sorted) - 1] AS cuts FROM (
        SELECT list_sort(list_distinct(list(edge))) AS list_distinct_sorted FROM (
          SELECT CASE WHEN (i * (n - 1)) % b = 0 THEN xs[(i * (n - 1)) // b + 1]
                      ELSE xs[(i * (n - 1)) // b + 1]
                           + (xs[(i * (n - 1)) // b + 2] - xs[(i * (n - 1)) // b + 1])
                             * (CAST((i * (n - 1)) % b AS DOUBLE) / b) END AS edge
          FROM (SELECT xs, len(xs) AS n, least({bins}, len(list_distinct(xs))) AS b
                FROM (SELECT list_sort(list(CAST({column} AS DOUBLE))) AS xs FROM {source}
                      WHERE {column} IS NOT NULL)),
               range(0, {bins} + 1) r(i) WHERE i <= b))
    """


def bucket_sql(column: str, cuts: str) -> str:
    return (
        f"CASE WHEN {column} IS NULL THEN 0 "
        f"ELSE 1 + len(list_filter({cuts}, lambda c: {column} > c)) END"
    )


@query(
    "numeric_profile",
    " UNION ALL ".join(
        f"""SELECT {i} AS feature_pos, '{n}' AS feature_name, count(*) AS sample_size,
               round(avg(CASE WHEN {e} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate,
               round(avg({e}), 6) AS mean, round(stddev_pop({e}), 6) AS std,
               min({e}) AS min, max({e}) AS max FROM lineitem"""
        for i, (n, e) in enumerate(
            (n, f"(CASE WHEN l_returnflag = 'N' THEN NULL ELSE {n} END)" if n == "l_tax" else n)
            for n in LINE_NUMERICS
        )
    ),
)
def numeric_profile_query(spark, sf):
    line = table(spark, sf, "lineitem").withColumn(
        "l_tax", F.when(F.col("l_returnflag") != "N", F.col("l_tax"))
    )
    profile = numeric_profile(line, LINE_NUMERICS)
    rounded = {c: F.round(c, 6) for c in ("missing_rate", "mean", "std")}
    return profile.withColumns(rounded).drop("value_count", "distinct_estimate")


@query(
    "cut_points",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS feature_name, i AS pos, round(cuts[i], 6) AS cut FROM
              ({edges_sql('lineitem', n, 10)}) e, range(1, 20) r(i) WHERE i <= len(cuts)"""
        for n in LINE_NUMERICS
    ),
)
def cut_points_query(spark, sf):
    line = table(spark, sf, "lineitem").select(*LINE_NUMERICS)
    cuts = cut_points(line, LINE_NUMERICS, 10)
    # at most nine numbers per feature
    rows = [(n, i + 1, float(c)) for n, cs in cuts.items() for i, c in enumerate(cs)]
    found = small_table(spark, rows, "feature_name string, pos bigint, cut double")
    return found.withColumn("cut", F.round("cut", 6))


def exploded(baseline):
    """Baseline buckets as rows."""
    return baseline.select(
        "feature_name", "sample_size", F.posexplode("expected_distribution").alias("bucket", "share")
    ).withColumn("share", F.round("share", 9))


@query(
    "baseline_numeric",
    " UNION ALL ".join(
        f"""(WITH e AS ({edges_sql('lineitem', n, 10)}),
             n AS (SELECT count(*) AS n FROM lineitem),
             h AS (SELECT {bucket_sql(n, '(SELECT cuts FROM e)')} AS bucket, count(*) AS c FROM lineitem GROUP BY 1)
             SELECT '{n}' AS feature_name, n AS sample_size, CAST(g.b AS INT) AS bucket,
                    round(coalesce(c, 0) / CAST(n AS DOUBLE), 9) AS share
             FROM range(0, 13) g(b) CROSS JOIN n LEFT JOIN h ON h.bucket = g.b
             WHERE g.b < (SELECT len(cuts) FROM e) + 2)"""
        for n in LINE_NUMERICS
    ),
)
def baseline_numeric(spark, sf):
    line = table(spark, sf, "lineitem")
    return exploded(build_baseline(line, FeatureSpec(LINE_NUMERICS), OPTIONS))


_PART_VALUES = """
    v AS (SELECT coalesce(nullif(trim(CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END), ''), '__missing__') AS value,
                 count(*) AS c FROM part GROUP BY 1),
    t AS (SELECT value, c, row_number() OVER (ORDER BY c DESC, value) AS rn FROM v WHERE value <> '__missing__'),
    n AS (SELECT CAST(sum(c) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS u,
                 CAST(sum(CASE WHEN value = '__missing__' THEN c ELSE 0 END) AS BIGINT) AS m FROM v)
"""


def _part(spark, sf):
    return table(spark, sf, "part").withColumn(
        "p_brand", F.when(F.col("p_size") % 7 != 0, F.col("p_brand"))
    )


@query(
    "baseline_categorical",
    f"""
    WITH {_PART_VALUES}
    SELECT 'p_brand' AS feature_name, n AS sample_size, 0 AS bucket, round(m / CAST(n AS DOUBLE), 9) AS share FROM n
    UNION ALL SELECT 'p_brand', n, CAST(rn AS INT), round(c / CAST(n AS DOUBLE), 9) FROM t, n WHERE rn <= 10
    UNION ALL SELECT 'p_brand', n, CAST((SELECT count(*) FROM t WHERE rn <= 10) AS INT) + 1,
        round((n - m - (SELECT sum(c) FROM t WHERE rn <= 10)) / CAST(n AS DOUBLE), 9) FROM n
    """,
)
def baseline_categorical(spark, sf):
    return exploded(build_baseline(_part(spark, sf), FeatureSpec((), ("p_brand",)), OPTIONS))


@query(
    "category_profile",
    f"""
    WITH {_PART_VALUES}
    SELECT n AS sample_size, round(m / CAST(n AS DOUBLE), 9) AS missing_rate, u AS unique_value_count,
           (SELECT string_agg(value, ',' ORDER BY rn) FROM t WHERE rn <= 10) AS tracked
    FROM n
    """,
)
def category_profile_query(spark, sf):
    profile = category_profile(category_counts(_part(spark, sf), ["p_brand"]), 10)
    return profile.select(
        "sample_size", F.round("missing_rate", 9).alias("missing_rate"), "unique_value_count",
        F.array_join("tracked_categories", ",").alias("tracked"),
    )


def event_halves(spark, sf, shifted: bool):
    """Events before the middle of the month as baseline, later ones as observed."""
    ev = table(spark, sf, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("double")
    )
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    before, after = ev.filter(F.col("ts") < middle), ev.filter(F.col("ts") >= middle)
    if shifted:
        after = after.withColumns(
            {
                "value": F.col("value") * 1.5,
                "event_type": F.when(F.col("event_type") == "error", "click").otherwise(F.col("event_type")),
            }
        )
    return before.select(*SPEC.all), after.select(*SPEC.all)


def _drift_sql(shifted: bool, min_samples: int = 100) -> str:
    value = "value * 1.5" if shifted else "value"
    kind = "CASE WHEN event_type = 'error' THEN 'click' ELSE event_type END" if shifted else "event_type"
    return f"""
    WITH x AS (SELECT ts, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
    b AS (SELECT value, k, event_type FROM x WHERE ts < TIMESTAMP '2024-01-16'),
    o AS (SELECT {value} AS value, k, {kind} AS event_type FROM x WHERE ts >= TIMESTAMP '2024-01-16'),
    ev AS ({edges_sql('b', 'value', 10)}), ek AS ({edges_sql('b', 'k', 10)}),
    tr AS (SELECT list(event_type ORDER BY c DESC, event_type) AS tracked FROM
             (SELECT event_type, count(*) AS c FROM b GROUP BY 1 ORDER BY c DESC, event_type LIMIT 10)),
    bb AS (SELECT unnest([struct_pack(f := 0, b := {bucket_sql('value', '(SELECT cuts FROM ev)')}),
                          struct_pack(f := 1, b := {bucket_sql('k', '(SELECT cuts FROM ek)')}),
                          struct_pack(f := 2, b := coalesce(nullif(list_position((SELECT tracked FROM tr), event_type), 0),
                                                   (SELECT len(tracked) + 1 FROM tr)))], recursive := true) FROM b),
    oo AS (SELECT unnest([struct_pack(f := 0, b := {bucket_sql('value', '(SELECT cuts FROM ev)')}),
                          struct_pack(f := 1, b := {bucket_sql('k', '(SELECT cuts FROM ek)')}),
                          struct_pack(f := 2, b := coalesce(nullif(list_position((SELECT tracked FROM tr), event_type), 0),
                                                   (SELECT len(tracked) + 1 FROM tr)))], recursive := true) FROM o),
    g AS (SELECT 0 AS f, b FROM range(0, 12) r(b) WHERE b < (SELECT len(cuts) + 2 FROM ev)
          UNION ALL SELECT 1, b FROM range(0, 12) r(b) WHERE b < (SELECT len(cuts) + 2 FROM ek)
          UNION ALL SELECT 2, b FROM range(0, 12) r(b) WHERE b < (SELECT len(tracked) + 2 FROM tr)),
    bc AS (SELECT f, b, count(*) AS c FROM bb GROUP BY 1, 2),
    oc AS (SELECT f, b, count(*) AS c FROM oo GROUP BY 1, 2),
    p AS (SELECT g.f, g.b,
            greatest(coalesce(bc.c, 0) / CAST((SELECT count(*) FROM b) AS DOUBLE), 1e-6::DOUBLE) AS e,
            greatest(coalesce(oc.c, 0) / CAST((SELECT count(*) FROM o) AS DOUBLE), 1e-6::DOUBLE) AS o
          FROM g LEFT JOIN bc ON bc.f = g.f AND bc.b = g.b LEFT JOIN oc ON oc.f = g.f AND oc.b = g.b),
    s AS (SELECT f, sum((o - e) * ln(o / e)) AS psi FROM p GROUP BY 1),
    r AS (SELECT f, ['value', 'k', 'event_type'][f + 1] AS feature_name,
                 CASE WHEN f < 2 THEN 'numeric' ELSE 'categorical' END AS feature_type, psi,
                 CASE WHEN psi >= 0.25 THEN 'drift' WHEN psi >= 0.1 THEN 'warning' ELSE 'stable' END AS status
          FROM s WHERE (SELECT count(*) FROM o) >= {min_samples})
    """


_REPORT = "SELECT feature_name, feature_type, round(psi, 6) AS psi, status FROM r"


def drift_report(spark, sf, shifted: bool = True):
    before, after = event_halves(spark, sf, shifted)
    baseline = build_baseline(before, SPEC, OPTIONS)
    return drift_features(after, baseline, OPTIONS).select(
        "feature_name", "feature_type", F.round("psi", 6).alias("psi"), "status"
    )


@query("drift_report", _drift_sql(True) + _REPORT)
def drift_report_query(spark, sf):
    return drift_report(spark, sf, shifted=True)


@query("drift_report_stable", _drift_sql(False) + _REPORT)
def drift_report_stable(spark, sf):
    return drift_report(spark, sf, shifted=False)


def _status_sql(min_samples: int, min_drifted: int) -> str:
    return (
        _drift_sql(True, min_samples)
        + f"""
    , c AS (SELECT count(*) FILTER (status = 'drift') AS d, count(*) FILTER (status = 'warning') AS w,
                   max(psi) AS psi FROM r)
    SELECT CASE WHEN (SELECT count(*) FROM o) < {min_samples} THEN 'insufficient_data'
                WHEN d >= {min_drifted} THEN 'drift_detected' WHEN d + w > 0 THEN 'warning' ELSE 'stable' END AS status,
           (SELECT count(*) FROM o) AS observed_sample_size, d AS drifted_feature_count,
           w AS warning_feature_count, round(coalesce(psi, 0.0), 6) AS max_feature_psi
    FROM c
    """
    )


def _status(spark, sf, options):
    before, after = event_halves(spark, sf, True)
    evaluation = drift_evaluation(after, build_baseline(before, SPEC, OPTIONS), options)
    return evaluation.select(
        "status", "observed_sample_size", "drifted_feature_count", "warning_feature_count",
        F.round("max_feature_psi", 6).alias("max_feature_psi"),
    )


@query("drift_status", _status_sql(100, 1))
def drift_status(spark, sf):
    return _status(spark, sf, DriftOptions(min_drifted_features=1))


@query("drift_gate", _status_sql(10_000_000_000, 1))
def drift_gate(spark, sf):
    return _status(
        spark, sf,
        DriftOptions(window_size=10_000_000_000, min_samples=10_000_000_000, min_drifted_features=1),
    )


@query(
    "drift_missing_feature",
    """
    SELECT 'l_comment' AS feature_name, CAST(count(*) AS BIGINT) AS observed_sample_size,
           round((1 - 1e-6::DOUBLE) * ln(1 / 1e-6::DOUBLE) + (1e-6::DOUBLE - 1) * ln(1e-6::DOUBLE), 6) AS psi,
           'drift' AS status
    FROM lineitem
    """,
)
def drift_missing_feature(spark, sf):
    line = table(spark, sf, "lineitem")
    reference = line.select(F.lit(1.0).alias("l_comment"))
    baseline = build_baseline(reference, FeatureSpec(("l_comment",)), OPTIONS)
    return drift_features(line.select("l_tax"), baseline, OPTIONS).select(
        "feature_name", "observed_sample_size", F.round("psi", 6).alias("psi"), "status"
    )


@query(
    "baseline_json",
    """
    SELECT CASE WHEN t = 1 THEN 'o_totalprice' ELSE 'o_orderpriority' END AS feature_name,
           CASE WHEN t = 1 THEN 'numeric' ELSE 'categorical' END AS feature_type,
           (SELECT count(*) FROM orders) AS sample_size,
           CASE WHEN t = 1 THEN 11 ELSE 7 END AS buckets,
           CASE WHEN t = 1 THEN '' ELSE (SELECT string_agg(p, ',' ORDER BY c DESC, p) FROM
              (SELECT o_orderpriority AS p, count(*) AS c FROM orders GROUP BY 1)) END AS tracked,
           CASE WHEN t = 1 THEN (SELECT round(max(o_totalprice), 2) FROM orders) END AS max_value
    FROM range(1, 3) r(t)
    """,
)
def baseline_json(spark, sf):
    orders = table(spark, sf, "orders")
    baseline = build_baseline(orders, FeatureSpec(("o_totalprice",), ("o_orderpriority",)), OPTIONS)
    back = baseline_from_json(baseline_to_json(baseline))
    return back.select(
        "feature_name", "feature_type", "sample_size",
        F.size("expected_distribution").alias("buckets"),
        F.array_join("tracked_categories", ",").alias("tracked"),
        F.round("metadata.max", 2).alias("max_value"),
    )
