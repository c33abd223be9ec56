"""Population stability of an observed table against a baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemark.functions.columns import MISSING, constant
from tidemark.functions.distributions import (
    category_bucket,
    feature_status,
    numeric_bucket,
    overall_status,
    psi_of_arrays,
)
from tidemark.operators.baseline import category_value, numeric_value
from tidemark.options import DriftOptions


def observed_counts(observed: DataFrame, baseline: Sequence[Row]) -> DataFrame:
    """Rows per (feature, baseline bucket), all features in one pass.

    The bucket definitions enter as literals; features the table lacks count as
    missing throughout.
    """
    cells = [
        F.struct(
            F.lit(b["feature_pos"]).alias("feature_pos"),
            F.lit(i).alias("i"),
            F.lit(b["feature_type"] == "numeric").alias("is_numeric"),
            (
                numeric_value(observed, b["feature_name"])
                if b["feature_type"] == "numeric"
                else F.lit(None).cast("double")
            ).alias("number"),
            (
                category_value(observed, b["feature_name"])
                if b["feature_type"] != "numeric"
                else F.lit(None).cast("string")
            ).alias("text"),
        )
        for i, b in enumerate(baseline)
    ]
    index = F.col("i")
    cuts = F.get(constant([b["cut_points"] or [] for b in baseline], "array<double>"), index)
    known = [[MISSING, *(b["tracked_categories"] or [])] for b in baseline]
    labels = F.get(constant(known, "array<string>"), index)
    longest = max(len(b["cut_points"] or []) for b in baseline)
    bucket = F.when(
        F.col("is_numeric"), numeric_bucket(F.col("number"), cuts, longest)
    ).otherwise(category_bucket(F.col("text"), labels))
    return (
        observed.select(F.inline(F.array(*cells)))
        .groupBy("feature_pos", bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def _scored(observed: DataFrame, baseline: DataFrame, options: DriftOptions) -> DataFrame:
    """One row per feature with its PSI, before the sample-size gate.

    The baseline has one small row per feature and enters as literals, so the
    observed table is aggregated without any join.
    """
    rows = sorted(baseline.collect(), key=lambda r: r["feature_pos"])
    if not rows:
        raise ValueError("the baseline has no features")
    counts = (
        observed_counts(observed, rows)
        .groupBy("feature_pos")
        .agg(
            F.sum("row_count").alias("observed_sample_size"),
            F.map_from_entries(F.collect_list(F.struct("bucket", "row_count"))).alias("counts"),
        )
    )
    place = F.array_position(constant([r["feature_pos"] for r in rows], "int"), F.col("feature_pos"))

    def given(field: str, kind: str) -> Column:
        return F.get(constant([r[field] for r in rows], kind), place.cast("int") - 1).alias(field)

    named = counts.select(
        "feature_pos", "observed_sample_size", "counts",
        given("feature_name", "string"), given("feature_type", "string"),
        given("bucket_labels", "array<string>"),
        given("expected_distribution", "array<double>").alias("baseline_distribution"),
    )
    size = F.col("observed_sample_size")
    shares = F.transform(
        F.sequence(F.lit(0), F.size("baseline_distribution") - 1),
        lambda bucket: F.coalesce(F.col("counts")[bucket], F.lit(0)) / size,
    )
    return (
        named.withColumn("observed_distribution", shares)
        .drop("counts")
        .withColumn(
            "psi", psi_of_arrays(F.col("baseline_distribution"), F.col("observed_distribution"))
        )
        .withColumn(
            "status",
            feature_status(F.col("psi"), options.warning_threshold, options.drift_threshold),
        )
    )


def drift_features(observed: DataFrame, baseline: DataFrame, options: DriftOptions) -> DataFrame:
    """Per-feature report, most drifted first; empty below ``min_samples`` rows."""
    return (
        _scored(observed, baseline, options)
        .filter(F.col("observed_sample_size") >= options.min_samples)
        .orderBy(F.col("psi").desc(), "feature_pos")
    )


def drift_evaluation(observed: DataFrame, baseline: DataFrame, options: DriftOptions) -> DataFrame:
    """The overall decision in one row, with the feature results as an array."""
    scored = _scored(observed, baseline, options)
    result = F.struct(
        (-F.col("psi")).alias("by_psi"),
        "feature_pos", "feature_name", "feature_type", "psi", "status", "bucket_labels",
        "baseline_distribution", "observed_distribution",
    )
    enough = F.coalesce(F.col("observed_sample_size") >= options.min_samples, F.lit(False))
    zero = F.lit(0).cast("bigint")
    return (
        scored.agg(
            F.max("observed_sample_size").alias("observed_sample_size"),
            F.count_if(F.col("status") == "drift").alias("drifted"),
            F.count_if(F.col("status") == "warning").alias("warned"),
            F.max("psi").alias("psi"),
            F.array_sort(F.collect_list(result)).alias("results"),
        )
        .select(
            F.when(
                enough, overall_status(F.col("drifted"), F.col("warned"), options.min_drifted_features)
            ).otherwise("insufficient_data").alias("status"),
            F.coalesce("observed_sample_size", zero).alias("observed_sample_size"),
            F.lit(options.min_samples).alias("min_samples"),
            F.lit(options.window_size).alias("window_size"),
            F.lit(options.warning_threshold).alias("warning_threshold"),
            F.lit(options.drift_threshold).alias("drift_threshold"),
            F.lit(options.min_drifted_features).alias("min_drifted_features"),
            F.when(enough, F.col("drifted")).otherwise(zero).alias("drifted_feature_count"),
            F.when(enough, F.col("warned")).otherwise(zero).alias("warning_feature_count"),
            F.when(enough, F.col("psi")).otherwise(F.lit(0.0)).alias("max_feature_psi"),
            F.when(enough, F.transform("results", lambda r: r.dropFields("by_psi", "feature_pos")))
            .otherwise(F.filter(F.transform("results", lambda r: r.dropFields("by_psi", "feature_pos")),
                                lambda r: F.lit(False)))
            .alias("feature_results"),
        )
    )
