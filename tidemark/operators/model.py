"""Class-balanced logistic regression: fit, score, prediction rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.operators.transforms import feature_stages, fit_features
from tidemark.options import FeatureSpec, ModelOptions
from tidemark.plans.ordered import positions

#: Relative improvement at which the start of the Newton steps is good enough.
START_TOL = 1e-9
#: Steps of the start at most; fewer where ``max_iter`` says so.
START_STEPS = 100


def train(
    df: DataFrame, spec: FeatureSpec, options: ModelOptions = ModelOptions(), label: str = "label"
) -> PipelineModel:
    """Fit features and classifier on the training rows, which are read once and kept.

    The penalty is ``1 / (C * rows)`` because the loss is a weighted mean here
    and a weighted sum in the objective that ``C`` belongs to; balanced weights
    add up to the number of rows.

    The solver ``newton`` reaches the same optimum to the last digits by
    reweighted least squares, for at most 4,096 feature columns.
    """
    rows = df.select(*[col(c) for c in spec.all], col(label))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < 4 * cores:
        # every iteration reads all rows: few, uneven partitions would leave cores idle
        rows = rows.repartition(2 * cores)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        classes = rows.groupBy(col(label).alias("y")).count().limit(3).collect()
        return _fit(rows, spec, options, label, classes)
    finally:
        rows.unpersist()


def _fit(
    df: DataFrame, spec: FeatureSpec, options: ModelOptions, label: str, classes: Sequence[Row]
) -> PipelineModel:
    total = sum(r["count"] for r in classes)
    if len(classes) != 2:
        raise ValueError("training needs rows of exactly two classes")
    weight = F.lit(1.0)
    if options.balanced:
        by_class = {r["y"]: total / (2.0 * r["count"]) for r in classes}
        weight = F.when(col(label) == 1, F.lit(by_class[1])).otherwise(F.lit(by_class[0]))
    fit = fit_features(df, spec)
    weighted = df.withColumns({"__weight": weight, "__label": col(label).cast("double")})
    stages = feature_stages(fit, df.schema)
    if options.solver == "newton":
        prepared = Pipeline(stages=stages).fit(weighted)
        rows = prepared.transform(weighted).select("features", "__label", "__weight")
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            link = "SELECT *, 1D / (1D + exp(-__eta)) AS __positive, CAST(__eta > 0 AS DOUBLE) AS __prediction FROM __THIS__"
            found = _newton(rows, options, total)
            return PipelineModel([*prepared.stages, found, SQLTransformer(statement=link)])
        finally:
            rows.unpersist()
    classifier = LogisticRegression(
        featuresCol="features", labelCol="__label", weightCol="__weight",
        predictionCol="__prediction", probabilityCol="__probability", rawPredictionCol="__raw",
        regParam=1.0 / (options.C * total), elasticNetParam=0.0, standardization=False,
        maxIter=options.max_iter, tol=options.tol,
    )
    return Pipeline(stages=[*stages, classifier]).fit(weighted)


def _newton(rows: DataFrame, options: ModelOptions, total: int) -> LinearRegressionModel:
    """Linear predictor of the penalized optimum, by reweighted least squares.

    It starts where ``lbfgs`` ends on the same rows, whose steps read blocks of rows
    and take a part of the time; what is returned comes from the steps here. A step is one weighted regression on the working response, solved from the
    Gram matrix that tasks add up. The penalty is a sum and a regression's loss
    a weighted mean of the response in its standard deviations, so its strength
    changes with the working weights and responses.
    """
    penalty = 1.0 / options.C
    solver = LinearRegression(
        featuresCol="features", labelCol="__target", weightCol="__step", predictionCol="__eta",
        solver="normal", elasticNetParam=0.0, standardization=False, tol=1e-14, maxIter=1000,
    )
    eta, y, w = F.col("__eta"), F.col("__label"), F.col("__weight")
    p = 1 / (1 + F.exp(-eta))
    # the floor changes the path only: weight times residual stays weight * (y - p)
    v = F.greatest(p * (1 - p), F.lit(1e-10))
    margin = F.when(y == 1, eta).otherwise(-eta)
    loss = w * (F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin))))
    start = LogisticRegression(
        featuresCol="features", labelCol="__label", weightCol="__weight", rawPredictionCol="__raw",
        regParam=penalty / total, elasticNetParam=0.0, standardization=False, tol=START_TOL,
        maxIter=min(options.max_iter, START_STEPS),
    ).fit(rows)
    found, last = np.append(start.coefficients.toArray(), start.intercept), float("inf")
    at = start.transform(rows).withColumn("__eta", vector_to_array("__raw")[1])
    for _ in range(options.max_iter):
        step = at.select("features", (eta + (y - p) / v).alias("__target"), (w * v).alias("__step"), loss.alias("__loss"))
        weight, target = F.col("__step"), F.col("__target")
        seen = step.agg(
            F.sum(weight).alias("weight"), F.sum("__loss").alias("loss"),
            (F.sum(weight * target) / F.sum(weight)).alias("mean"),
            (F.sum(weight * target * target) / F.sum(weight)).alias("square"),
        ).first()
        objective = seen["loss"] + penalty / 2 * float(found[:-1] @ found[:-1])
        if not objective <= last * (1 + 1e-9):
            raise ArithmeticError("Newton steps do not lead down; use the solver 'lbfgs'")
        spread = math.sqrt(max(seen["square"] - seen["mean"] ** 2, 0.0))
        model = solver.setRegParam(penalty / seen["weight"] * spread).fit(step)
        now = np.append(model.coefficients.toArray(), model.intercept)
        if np.abs(now - found).max() <= options.tol * max(1.0, np.abs(now).max()):
            return model
        found, last, at = now, objective, model.transform(rows)
    raise ArithmeticError(f"no optimum within {options.max_iter} steps")


def score(
    model: PipelineModel,
    df: DataFrame,
    options: ModelOptions = ModelOptions(),
    apply_threshold: bool = False,
) -> DataFrame:
    """Add class, flag, probability and the echoed threshold to every row.

    The class is decided at 0.5; the configured threshold is only reported,
    unless ``apply_threshold`` asks for it.
    """
    scored = model.transform(df)
    positive = F.col("__positive") if "__positive" in scored.columns else vector_to_array("__probability")[1]
    scored = scored.withColumn("probability", positive)
    decided = (
        (F.col("probability") >= options.decision_threshold).cast("int")
        if apply_threshold
        else F.col("__prediction").cast("int")
    )
    return scored.select(
        *[col(c) for c in df.columns],
        decided.alias("predicted_class"),
        (decided == 1).alias("predicted_positive"),
        F.col("probability"),
        F.lit(options.decision_threshold).alias("decision_threshold"),
    )


def prediction_rows(
    scored: DataFrame, request: str, order: str, model: Mapping[str, str | None]
) -> DataFrame:
    """Response rows: position in the request, decision, and the model they came from."""
    placed = positions(scored, [request], order, "position")
    reference = F.struct(*[F.lit(v).cast("string").alias(k) for k, v in model.items()])
    return placed.select(
        col(request),
        (F.col("position") - 1).alias("index"),
        "predicted_class", "predicted_positive", "probability", "decision_threshold",
        reference.alias("model"),
    )
