"""Imputation, scaling and one-hot encoding, fitted on one table and applied to any."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.ml import Transformer
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col, numeric_sql
from tidemark.operators.baseline import numeric_value
from tidemark.options import FeatureSpec
from tidemark.plans.lookup import lookup_join
from tidemark.plans.ordered import ROWS_PER_BLOCK, range_positions
from tidemark.plans.quantiles import exact_quantiles
from tidemark.session import stored

# One-hot columns become model coefficients, which live on the driver.
MAX_CATEGORIES = 100_000


@dataclass(frozen=True)
class NumericFit:
    name: str
    median: float
    mean: float
    std: float

    @property
    def divisor(self) -> float:
        return self.std if self.std > 0 else 1.0


@dataclass(frozen=True)
class CategoryFit:
    name: str
    mode: str | None
    categories: tuple[str, ...]


@dataclass(frozen=True)
class FeatureFit:
    numeric: tuple[NumericFit, ...]
    categorical: tuple[CategoryFit, ...]

    @property
    def width(self) -> int:
        return len(self.numeric) + sum(len(c.categories) for c in self.categorical)


def fit_medians(df: DataFrame, features: Sequence[str], **quantile_settings: int) -> dict[str, float]:
    """Exact medians, the mean of the two middle values for even counts; 0 without values."""
    values = {n: numeric_value(df, n) for n in features}
    row = df.agg(*[F.count(v).alias(f"c{i}") for i, v in enumerate(values.values())]).first()
    counts = {n: row[f"c{i}"] for i, n in enumerate(features)}
    half = {n: [Fraction(1, 2)] for n in features}
    found = exact_quantiles(df, values, half, counts, **quantile_settings)
    return {n: found[n][0] if n in found else 0.0 for n in features}


def fit_numeric(df: DataFrame, features: Sequence[str]) -> tuple[NumericFit, ...]:
    """Median, then mean and population std of the imputed values."""
    if not features:
        return ()
    medians = fit_medians(df, features)
    filled = {n: F.coalesce(numeric_value(df, n), F.lit(medians[n])) for n in features}
    row = df.agg(
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(filled.values())],
        *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(filled.values())],
    ).first()
    return tuple(
        NumericFit(n, medians[n], row[f"m{i}"], row[f"s{i}"]) for i, n in enumerate(features)
    )


def value_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows per (feature, raw value), missing values left out."""
    cells = [
        F.struct(F.lit(n).alias("feature"), col(n).cast("string").alias("value")) for n in features
    ]
    return (
        df.select(F.inline(F.array(*cells)))
        .filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def modes(counts: DataFrame) -> DataFrame:
    """Most frequent value per feature, the smaller one on ties."""
    return counts.groupBy("feature").agg(
        F.min(F.struct((-F.col("row_count")).alias("neg"), F.col("value"))).getField("value").alias("mode")
    )


def fit_categories(
    df: DataFrame, features: Sequence[str], max_categories: int = MAX_CATEGORIES
) -> tuple[CategoryFit, ...]:
    """Mode and sorted categories per feature; their total number is checked first."""
    if not features:
        return ()
    rows = value_counts(df, features).limit(max_categories + 1).collect()
    if len(rows) > max_categories:
        raise ValueError(
            f"more than {max_categories} categories are too many for columns of their own; see encode_sparse")
    fits = []
    for n in features:
        found = {r["value"]: r["row_count"] for r in rows if r["feature"] == n}
        mode = min(found, key=lambda v: (-found[v], v)) if found else None
        fits.append(CategoryFit(n, mode, tuple(sorted(found))))
    return tuple(fits)


def fit_features(df: DataFrame, spec: FeatureSpec) -> FeatureFit:
    if not spec.all:
        raise ValueError("at least one training feature is required")
    return FeatureFit(fit_numeric(df, spec.numeric), fit_categories(df, spec.categorical))


def impute_scale(df: DataFrame, fits: Sequence[NumericFit]) -> DataFrame:
    """Replace numeric columns by their imputed, standardized values."""
    return df.withColumns(
        {
            f.name: (F.coalesce(numeric_value(df, f.name), F.lit(f.median)) - F.lit(f.mean))
            / F.lit(f.divisor)
            for f in fits
        }
    )


def impute_onehot(df: DataFrame, fits: Sequence[CategoryFit]) -> DataFrame:
    """Replace categorical columns by 0/1 columns; unseen values give all zeros."""
    encoded = {}
    for f in fits:
        value = F.coalesce(col(f.name).cast("string"), F.lit(f.mode))
        for c in f.categories:
            encoded[f"{f.name}_{c}"] = (value == F.lit(c)).cast("double")
    return df.withColumns(encoded).drop(*[f.name for f in fits])


def category_dictionary(df: DataFrame, features: Sequence[str], rows_per_part: int = ROWS_PER_BLOCK) -> DataFrame:
    """``feature, value, row_count, index``: categories in their order, numbered over all features.

    The number is the column a category has in the one-hot encoding, and as many
    columns are possible as there are categories: the table stays in Spark.
    Features follow each other in the given order.
    """
    place = F.array_position(F.array(*[F.lit(n) for n in features]), F.col("feature"))
    counts = stored(value_counts(df, features).withColumn("__place", place), "categories")
    numbered = range_positions(counts, [F.col("__place"), F.col("value")], "index", counts.count(), rows_per_part)
    return numbered.select("feature", "value", "row_count", "index")


def encode_sparse(df: DataFrame, features: Sequence[str], dictionary: DataFrame, row: Sequence[str]) -> DataFrame:
    """``row, feature, index, value`` of the ones in the one-hot encoding of every row.

    A missing value takes its feature's mode; an unseen one has no row. Only the
    modes, one per feature, are part of the plan; categories are joined, and a
    category that holds a large share of the rows is spread.
    """
    mode = {r["feature"]: r["mode"] for r in modes(dictionary).collect()}
    cells = [
        F.struct(F.lit(n).alias("feature"),
                 F.coalesce(col(n).cast("string"), F.lit(mode.get(n))).alias("category"))
        for n in features
    ]
    long = df.select(*[col(c) for c in row], F.inline(F.array(*cells))).filter(F.col("category").isNotNull())
    known = dictionary.select("feature", F.col("value").alias("category"), "index")
    found = lookup_join(long, known, ["feature", "category"], spread_by=list(row))
    return found.select(*[col(c) for c in row], "feature", "index", F.lit(1.0).alias("value"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def feature_stages(
    fit: FeatureFit, schema: T.StructType, output: str = "features"
) -> list[Transformer]:
    """The fitted transform as ordinary pipeline stages, so it is saved with the model.

    ``schema`` is that of the rows the fit has seen: numbers are read by the same
    rule when scoring.
    """
    stages: list[Transformer] = []
    exprs, inputs = [], []
    for i, f in enumerate(fit.numeric):
        value = numeric_sql(f.name, schema[f.name].dataType)
        exprs.append(
            f"(coalesce({value}, {f.median!r}D) - ({f.mean!r}D)) / {f.divisor!r}D AS __num_{i}"
        )
        inputs.append(f"__num_{i}")
    usable = [(i, f) for i, f in enumerate(fit.categorical) if f.categories]
    for i, f in usable:
        mode = "'" + f.mode.replace("\\", "\\\\").replace("'", "\\'") + "'"
        exprs.append(f"coalesce(CAST({_quoted(f.name)} AS STRING), {mode}) AS __cat_{i}")
    stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__"))
    if usable:
        raw = [f"__cat_{i}" for i, _ in usable]
        index = [f"__idx_{i}" for i, _ in usable]
        hot = [f"__hot_{i}" for i, _ in usable]
        # unseen values take the extra slot, which is the one the encoder drops
        stages += [
            StringIndexerModel.from_labels(
                list(f.categories), inputCol=r, outputCol=x, handleInvalid="keep"
            )
            for (_, f), r, x in zip(usable, raw, index)
        ]
        stages.append(
            OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True, handleInvalid="error")
        )
        inputs += hot
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output))
    return stages
