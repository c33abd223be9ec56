"""Reference distributions of a training table, one row per feature."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import (
    ALL_VALUES,
    MISSING,
    OTHER,
    col,
    constant,
    finite_or_null,
    normalize_category,
    to_number,
)
from tidemark.functions.distributions import numeric_bucket
from tidemark.options import DriftOptions, FeatureSpec
from tidemark.plans.local import small_table
from tidemark.plans.quantiles import exact_quantiles, quantiles_of_counts, sketch_quantiles
from tidemark.session import cut_lineage

SALTS = 64
EMPTY = "cannot build a drift baseline from an empty table"

METADATA_SCHEMA = T.StructType(
    [
        T.StructField("missing_rate", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("std", T.DoubleType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("unique_value_count", T.LongType()),
        T.StructField("top_categories", T.ArrayType(T.StringType())),
    ]
)
BASELINE_SCHEMA = T.StructType(
    [
        T.StructField("feature_pos", T.IntegerType()),
        T.StructField("feature_name", T.StringType()),
        T.StructField("feature_type", T.StringType()),
        T.StructField("sample_size", T.LongType()),
        T.StructField("bucket_labels", T.ArrayType(T.StringType())),
        T.StructField("expected_distribution", T.ArrayType(T.DoubleType())),
        T.StructField("cut_points", T.ArrayType(T.DoubleType())),
        T.StructField("tracked_categories", T.ArrayType(T.StringType())),
        T.StructField("metadata", METADATA_SCHEMA),
    ]
)


def numeric_value(df: DataFrame, name: str) -> Column:
    """Numeric reading of a column; a column the table lacks is all missing."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    kind = df.schema[name].dataType
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return finite_or_null(name)
    return to_number(name)


def category_value(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(MISSING)
    return normalize_category(name)


def numeric_profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Count, missing rate, mean, population std, min and max of every feature, in one pass.

    Features are read as rows, so the compiled aggregate does not grow with them.
    """
    cells = [
        F.struct(F.lit(i).alias("feature_pos"), numeric_value(df, name).alias("value"))
        for i, name in enumerate(features)
    ]
    value = F.col("value")
    return (
        df.select(F.inline(F.array(*cells)))
        .groupBy("feature_pos")
        .agg(
            F.count(F.lit(1)).alias("sample_size"),
            F.count(value).alias("value_count"),
            F.avg(value).alias("mean"),
            F.stddev_pop(value).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.approx_count_distinct(value).alias("distinct_estimate"),
        )
        .select(
            "feature_pos",
            F.get(constant(features, "string"), F.col("feature_pos")).alias("feature_name"),
            "sample_size",
            "value_count",
            ((F.col("sample_size") - F.col("value_count")) / F.col("sample_size")).alias("missing_rate"),
            "mean", "std", "min", "max", "distinct_estimate",
        )
    )


def _few_values(df: DataFrame, features: Sequence[str], limit: int) -> dict[str, dict[float, int]] | None:
    """Value counts of columns with few distinct values; None if they are not so few."""
    cells = [
        F.struct(F.lit(n).alias("feature"), numeric_value(df, n).alias("value")) for n in features
    ]
    counted = (
        df.select(F.inline(F.array(*cells)))
        .filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .count()
        .limit(limit * len(features) + 1)
        .collect()
    )
    if len(counted) > limit * len(features):
        return None
    found: dict[str, dict[float, int]] = {n: {} for n in features}
    for r in counted:
        found[r["feature"]][r["value"] + 0.0] = r["count"]
    return found


def cut_points(
    df: DataFrame,
    features: Sequence[str],
    bin_count: int,
    profile: Mapping[str, Mapping] | None = None,
    method: str = "exact",
    **quantile_settings: int,
) -> dict[str, list[float]]:
    """Inner quantile edges per feature, ready for right-closed buckets.

    The number of bins is the smaller of ``bin_count`` and the distinct values.
    Columns that the profile says have few values are counted value by value,
    which gives both numbers; the others have more values than bins.
    """
    if profile is None:
        profile = {r["feature_name"]: r.asDict() for r in numeric_profile(df, features).collect()}
    filled = [n for n in features if n in profile and profile[n]["value_count"] > 0]
    edges: dict[str, list[float]] = {}
    limit = 4 * bin_count + 64
    few = [n for n in filled if profile[n]["distinct_estimate"] <= limit]
    if few:
        for n, counts in (_few_values(df, few, 2 * limit) or {}).items():
            if len(counts) > 1:
                bins = min(bin_count, len(counts))
                edges[n] = quantiles_of_counts(counts, [Fraction(i, bins) for i in range(bins + 1)])
            else:
                edges[n] = []
    many = [n for n in filled if n not in edges]
    values = {n: numeric_value(df, n) for n in many}
    shares = [Fraction(i, bin_count) for i in range(bin_count + 1)]
    if method not in ("exact", "approx"):
        raise ValueError(f"unknown quantile method '{method}'")
    if many and method == "exact":
        counts = {n: profile[n]["value_count"] for n in many}
        edges |= exact_quantiles(df, values, dict.fromkeys(many, shares), counts, **quantile_settings)
    elif many:
        found, _ = sketch_quantiles(df, [(values[n], [float(s) for s in shares]) for n in many])
        edges |= dict(zip(many, found, strict=True))
    # duplicate edges collapse first, only then the outer two are cut off
    return {n: sorted(set(edges.get(n, [])))[1:-1] for n in features}


def interval_labels(cuts: Sequence[float]) -> list[str]:
    """Display names of the buckets between cut points; never used as keys."""

    def shorten(x: float, digits: int) -> float:
        if x == 0 or not math.isfinite(x):
            return x
        if int(x) == 0:
            digits += -math.floor(math.log10(abs(x))) - 1
        return round(x, digits)

    if not cuts:
        return [MISSING, ALL_VALUES]
    digits = 3
    while digits < 20 and len({shorten(c, digits) for c in cuts}) < len(cuts):
        digits += 1
    names = ["-inf", *[str(shorten(c, digits)) for c in cuts], "inf"]
    return [MISSING, *[f"({a}, {b}]" for a, b in zip(names, names[1:])]]


def numeric_histogram(
    df: DataFrame, cuts: Mapping[str, Sequence[float]], positions: Mapping[str, int] | None = None
) -> DataFrame:
    """Rows per (feature, bucket); every feature is bucketed in the same pass.

    The buckets are right-closed and include the missing one, so the counts of a
    feature add up to all rows.
    """
    positions = positions or {n: i for i, n in enumerate(cuts)}
    cells = [
        F.struct(
            F.lit(positions[n]).alias("feature_pos"),
            F.lit(i).alias("i"),
            numeric_value(df, n).alias("value"),
        )
        for i, n in enumerate(cuts)
    ]
    given = F.get(constant([list(c) for c in cuts.values()], "array<double>"), F.col("i"))
    longest = max(len(c) for c in cuts.values())
    return (
        df.select(F.inline(F.array(*cells)))
        .groupBy("feature_pos", numeric_bucket(F.col("value"), given, longest).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def category_counts(
    df: DataFrame, features: Sequence[str], positions: Mapping[str, int] | None = None
) -> DataFrame:
    """Rows per (feature, normalized value)."""
    positions = positions or {n: i for i, n in enumerate(features)}
    cells = [
        F.struct(F.lit(positions[n]).alias("feature_pos"), category_value(df, n).alias("value"))
        for n in features
    ]
    return (
        df.select(F.inline(F.array(*cells)))
        .groupBy("feature_pos", "value")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def category_profile(counts: DataFrame, top_k: int) -> DataFrame:
    """Sample size, missing rate, distinct values and most frequent values per feature.

    No window sorts the distinct values. They are dealt to salts by hash, and
    the ``top_k``-th best of the salts' best values bounds the ``top_k``-th best
    of all from below; what reaches the bound is little more than ``top_k``
    values and decides exactly. Counts give a first bound without touching the
    values, so that these are compared only among the ties at that count. Ties
    go to the smaller value.
    """
    salts = max(SALTS, 8 * top_k)
    special = F.col("value").isin(MISSING, OTHER)
    # read three times: as a table of distinct values, not as the rows below it
    salted = cut_lineage(counts.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int")))
    per_salt = salted.groupBy("feature_pos", "salt").agg(
        F.sum("row_count").alias("rows"),
        F.count(F.lit(1)).alias("values"),
        F.sum(F.when(F.col("value") == MISSING, F.col("row_count"))).alias("missing"),
        F.max(F.when(~special, F.col("row_count"))).alias("most"),
    )
    totals = cut_lineage(per_salt.groupBy("feature_pos").agg(
        F.sum("rows").alias("sample_size"),
        F.sum("values").alias("unique_value_count"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"),
        # one entry per salt
        F.get(F.sort_array(F.collect_list("most"), asc=False), F.lit(top_k - 1)).alias("least"),
    ))
    entry = F.struct((-F.col("row_count")).alias("neg"), F.col("value"))
    frequent = salted.filter(~special).join(F.broadcast(totals.select("feature_pos", "least")), "feature_pos") \
        .filter(F.col("least").isNull() | (F.col("row_count") >= F.col("least"))) \
        .select("feature_pos", "salt", entry.alias("entry"))
    bound = frequent.groupBy("feature_pos", "salt").agg(F.min("entry").alias("first")) \
        .groupBy("feature_pos").agg(F.get(F.sort_array(F.collect_list("first")), F.lit(top_k - 1)).alias("last"))
    best = frequent.join(F.broadcast(bound), "feature_pos") \
        .filter(F.col("last").isNull() | (F.col("entry") <= F.col("last"))) \
        .groupBy("feature_pos").agg(F.slice(F.sort_array(F.collect_list("entry")), 1, top_k).alias("best"))
    none = F.array().cast("array<struct<neg: bigint, value: string>>")
    merged = totals.join(F.broadcast(best), "feature_pos", "left").withColumn("best", F.coalesce("best", none))
    return merged.select(
        "feature_pos",
        "sample_size",
        (F.col("missing") / F.col("sample_size")).alias("missing_rate"),
        "unique_value_count",
        "missing",
        F.col("best.value").alias("tracked_categories"),
        F.transform("best.neg", lambda n: -n).alias("tracked_counts"),
    )


def _numeric_baseline(df: DataFrame, features: Sequence[str], options: DriftOptions,
                      method: str) -> DataFrame:
    profile = {r["feature_name"]: r.asDict() for r in numeric_profile(df, features).collect()}
    if not profile:
        raise ValueError(EMPTY)
    cuts = cut_points(df, features, options.numeric_bin_count, profile, method)
    # one row per feature
    stats = small_table(
        df.sparkSession,
        [
            (
                i, n, "numeric", profile[n]["sample_size"], interval_labels(cuts[n]), cuts[n], [],
                (
                    profile[n]["missing_rate"], profile[n]["mean"], profile[n]["std"],
                    profile[n]["min"], profile[n]["max"], None, None,
                ),
            )
            for i, n in enumerate(features)
        ],
        T.StructType([f for f in BASELINE_SCHEMA.fields if f.name != "expected_distribution"]),
    )
    counted = numeric_histogram(df, cuts).groupBy("feature_pos").agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "row_count"))).alias("counts")
    )
    shares = F.transform(
        F.sequence(F.lit(0), F.size("bucket_labels") - 1),
        lambda bucket: F.coalesce(F.col("counts")[bucket], F.lit(0)) / F.col("sample_size"),
    )
    return (
        counted.join(F.broadcast(stats), "feature_pos")
        .withColumn("expected_distribution", shares)
        .select(*BASELINE_SCHEMA.names)
    )


def _categorical_baseline(df: DataFrame, features: Sequence[str], first: int,
                          options: DriftOptions) -> DataFrame:
    positions = {n: first + i for i, n in enumerate(features)}
    profile = category_profile(category_counts(df, features, positions), options.categorical_top_k)
    size, tracked = F.col("sample_size"), F.col("tracked_categories")
    rest = (
        size
        - F.col("missing")
        - F.aggregate("tracked_counts", F.lit(0).cast("bigint"), lambda a, n: a + n)
    )
    counts = F.concat(F.array("missing"), F.col("tracked_counts"), F.array(rest))
    names = F.element_at(
        F.create_map(*[F.lit(v) for n, p in positions.items() for v in (p, n)]), F.col("feature_pos")
    )
    null = F.lit(None).cast("double")
    return profile.select(
        "feature_pos",
        names.alias("feature_name"),
        F.lit("categorical").alias("feature_type"),
        size.alias("sample_size"),
        F.concat(F.array(F.lit(MISSING)), tracked, F.array(F.lit(OTHER))).alias("bucket_labels"),
        F.transform(counts, lambda n: n / size).alias("expected_distribution"),
        constant([], "double").alias("cut_points"),
        tracked.alias("tracked_categories"),
        F.struct(
            F.col("missing_rate"),
            null.alias("mean"),
            null.alias("std"),
            null.alias("min"),
            null.alias("max"),
            F.col("unique_value_count"),
            tracked.alias("top_categories"),
        ).alias("metadata"),
    )


def build_baseline(
    df: DataFrame, spec: FeatureSpec, options: DriftOptions, method: str = "exact"
) -> DataFrame:
    """Baseline of all features: numeric ones first, each with its buckets and shares."""
    if not spec.all:
        raise ValueError("a baseline needs at least one feature")
    parts = []
    if not spec.numeric and df.isEmpty():
        raise ValueError(EMPTY)
    if spec.numeric:
        parts.append(_numeric_baseline(df, spec.numeric, options, method))
    if spec.categorical:
        parts.append(_categorical_baseline(df, spec.categorical, len(spec.numeric), options))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def baseline_to_json(baseline: DataFrame) -> DataFrame:
    """One JSON document per feature, for exchange with other systems."""
    return baseline.select(
        "feature_pos", "feature_name", F.to_json(F.struct(*BASELINE_SCHEMA.names)).alias("payload")
    )


def baseline_from_json(documents: DataFrame) -> DataFrame:
    return documents.select(F.from_json(col("payload"), BASELINE_SCHEMA).alias("b")).select("b.*")


def attach_baseline(models: DataFrame, baseline: DataFrame) -> DataFrame:
    """The rows of ``models``, each with every feature of one shared baseline.

    The baseline has one small row per feature, which enters as literals.
    """
    rows = sorted(baseline_to_json(baseline).collect(), key=lambda r: r["feature_pos"])
    documents = [r["payload"] for r in rows]
    payload = F.explode(constant(documents, "string")).alias("payload")
    parsed = models.select("*", payload).withColumn("b", F.from_json("payload", BASELINE_SCHEMA))
    return parsed.select(*[col(c) for c in models.columns], "b.*")
