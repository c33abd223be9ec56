"""Target encoding, feature groups and schema alignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col, is_missing, normalize_category, strip, to_number
from tidemark.options import DatasetOptions, FeatureSpec


def rename_columns(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Rename by exact name; names the table lacks are ignored."""
    return df.toDF(*[renames.get(name, name) for name in df.columns])


def coerce_numeric(df: DataFrame, columns: Sequence[str], strict: bool = True) -> DataFrame:
    """Read columns as numbers, anything else becoming null.

    With ``strict`` a column the table lacks is an error, otherwise it is skipped.
    """
    absent = [c for c in columns if c not in df.columns]
    if absent and strict:
        raise ValueError(f"numeric coercion columns are absent: {', '.join(sorted(absent))}")
    numeric = (T.NumericType, T.BooleanType)
    return df.withColumns(
        {
            c: to_number(c)
            for c in columns
            if c in df.columns and not isinstance(df.schema[c].dataType, numeric)
        }
    )


def normalize_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: normalize_category(c) for c in columns})


def encode_target(df: DataFrame, target: str, positive: str, label: str = "label") -> DataFrame:
    """Add a 0/1 label. Needs one small job to look at the classes."""
    kind = df.schema[target].dataType
    value = col(target)
    if df.filter(is_missing(df, target)).limit(1).count():
        raise ValueError("the target column has missing values")
    if isinstance(kind, T.BooleanType):
        return df.withColumn(label, value.cast("int"))
    if isinstance(kind, T.NumericType):
        whole = value.try_cast("bigint")
        if df.agg(F.bool_and(F.coalesce(whole.isin(0, 1), F.lit(False))).alias("binary")).first()["binary"]:
            return df.withColumn(label, whole.cast("int"))
    text = strip(target)
    found = [r[0] for r in df.select(text.alias("c")).distinct().orderBy("c").limit(3).collect()]
    if len(found) != 2:
        raise ValueError(f"a binary target needs exactly two classes, found {found}")
    if positive not in found:
        raise ValueError(f"positive class '{positive}' is not among the target values {found}")
    return df.withColumn(label, (text == F.lit(positive)).cast("int"))


def resolve_features(df: DataFrame, options: DatasetOptions) -> FeatureSpec:
    """Numeric and categorical features: listed ones first, the rest by type if asked."""
    available = df.columns
    for section, names in (
        ("data.numeric_features", options.numeric_features),
        ("data.categorical_features", options.categorical_features),
    ):
        absent = sorted(set(names) - set(available))
        if absent:
            raise ValueError(f"columns listed in '{section}' are absent: {', '.join(absent)}")
    both = sorted(set(options.numeric_features) & set(options.categorical_features))
    if both:
        raise ValueError(f"columns listed as numeric and as categorical: {', '.join(both)}")
    listed = (*options.numeric_features, *options.categorical_features)
    if listed and not options.infer_remaining_features:
        return FeatureSpec(tuple(options.numeric_features), tuple(options.categorical_features))
    rest = [f for f in df.schema.fields if f.name not in listed]
    is_numeric = {f.name: isinstance(f.dataType, (T.NumericType, T.BooleanType)) for f in rest}
    return FeatureSpec(
        (*options.numeric_features, *[n for n, yes in is_numeric.items() if yes]),
        (*options.categorical_features, *[n for n, yes in is_numeric.items() if not yes]),
    )


def prepare(
    df: DataFrame, options: DatasetOptions, keep: Sequence[str] = (), label: str = "label"
) -> tuple[DataFrame, FeatureSpec]:
    """Coerce, encode the target, drop target / ids / excluded columns, resolve features.

    ``keep`` columns (such as the row id a split needs) stay in the table but
    are not features.
    """
    coerced = coerce_numeric(df, options.numeric_coercion_columns)
    removed = {options.target, *options.id_columns, *options.drop_columns}
    absent = sorted(removed - set(coerced.columns))
    if absent:
        raise ValueError(f"columns to exclude are absent: {', '.join(absent)}")
    encoded = encode_target(coerced, options.target, options.positive_class, label)
    features = [c for c in coerced.columns if c not in removed]
    spec = resolve_features(coerced.select(*[col(c) for c in features if c not in keep]), options)
    kept = [c for c in keep if c not in features]
    return encoded.select(*[col(c) for c in (*kept, *features)], F.col(label)), spec


def align_schema(df: DataFrame, expected: Mapping[str, str], coerce: Sequence[str] = ()) -> DataFrame:
    """Exactly the expected columns, in order: absent ones null, extra ones dropped."""
    present = set(df.columns)
    aligned = df.select(
        *[
            col(name) if name in present else F.lit(None).cast(kind).alias(name)
            for name, kind in expected.items()
        ]
    )
    return coerce_numeric(aligned, [c for c in coerce if c in present], strict=False)
