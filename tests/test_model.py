from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.evaluate import classification_metrics, metrics_long, ranking_metrics
from tidemark.operators.features import prepare
from tidemark.operators.model import prediction_rows, score, train
from tidemark.operators import splits
from tidemark.operators.splits import assign_splits, split_quotas, split_sizes
from tidemark.operators.transforms import (
    feature_stages,
    category_dictionary,
    encode_sparse,
    fit_categories,
    fit_features,
    fit_medians,
    fit_numeric,
    impute_onehot,
    impute_scale,
)
from tidemark.options import FeatureSpec, ModelOptions, SplitOptions


def test_quarter_splits_of_24_rows(spark, churn, churn_options):
    prepared, _ = prepare(churn, churn_options, keep=("customerID",))
    split = assign_splits(prepared, "label", "customerID", SplitOptions(0.25, 0.25, 42))
    sizes = {(r["split"], r["label"]): r["row_count"] for r in split_sizes(split, ("split", "label")).collect()}
    assert sizes == {("train", 0): 6, ("train", 1): 6, ("validation", 0): 3, ("validation", 1): 3,
                     ("test", 0): 3, ("test", 1): 3}
    assert split.select("customerID").distinct().count() == 24


def test_split_without_validation(spark, churn, churn_options):
    prepared, _ = prepare(churn, churn_options, keep=("customerID",))
    split = assign_splits(prepared, "label", "customerID", SplitOptions(0.25, 0))
    assert {r["split"] for r in split.select("split").distinct().collect()} == {"train", "test"}


@pytest.mark.parametrize("options", [SplitOptions(0.2, 0.1), SplitOptions(0.3, 0), SplitOptions(0.07, 0.41, 5)])
def test_cells_do_not_change_the_split(spark, options):
    df = spark.range(3000).select("id", (F.col("id") % 7 == 0).cast("int").alias("y"))
    plain = assign_splits(df, "y", "id", options)
    cells = assign_splits(df, "y", "id", options, rows_per_cell=40)
    assert sorted(plain.collect()) == sorted(cells.collect())
    classes = df.groupBy(F.col("y").alias("label")).agg(F.count("*").alias("n"))
    quotas = {r["label"]: (r["test"], r["validation"]) for r in split_quotas(classes, options).collect()}
    got = {(r["y"], r["split"]): r["row_count"] for r in split_sizes(plain, ("y", "split")).collect()}
    for y, (test, validation) in quotas.items():
        assert got[y, "test"] == test and got.get((y, "validation"), 0) == validation


@pytest.mark.parametrize("options", [SplitOptions(0.2, 0.1), SplitOptions(0.3, 0), SplitOptions(0.07, 0.41, 5)])
def test_quotas_of_few_and_of_many_classes_agree(spark, monkeypatch, options):
    rng = np.random.default_rng(2)
    sizes = [(f"c{i}", int(n)) for i, n in enumerate(rng.integers(2, 60, 150))] + [("é", 5), ("Z", 5), ("", 5)]
    classes = spark.createDataFrame(sizes, "label string, n long")
    few = split_quotas(classes, options)
    monkeypatch.setattr(splits, "FEW_CLASSES", 10)
    many = split_quotas(classes, options).select(few.columns)
    assert few.dtypes == many.dtypes and sorted(few.collect()) == sorted(many.collect())


def test_too_few_rows_to_split(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id int, y int")
    with pytest.raises(ValueError, match="too few rows"):
        assign_splits(df, "y", "id", SplitOptions(0.3, 0))


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame(
        {"id": range(n), "x": rng.normal(50, 20, n), "z": rng.exponential(3, n), "flat": 2.0,
         "c": rng.choice(["a", "b", "it's"], n), "d": rng.choice(["u", "v"], n)}
    )
    logit = 0.05 * (pdf.x - 50) - 0.3 * pdf.z + (pdf.c == "a") * 1.0
    pdf["label"] = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    pdf.loc[::9, "x"] = None
    pdf["d"] = pdf.d.where(pdf.index % 7 > 0, None)
    return spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).cache()


SPEC = FeatureSpec(("x", "z", "flat"), ("c", "d"))


def test_fitted_values(spark, mixed):
    pdf = mixed.toPandas()
    assert fit_medians(mixed, ["x"])["x"] == pytest.approx(pdf.x.median())
    x, _, flat = fit_numeric(mixed, SPEC.numeric)
    filled = pdf.x.fillna(pdf.x.median())
    assert (x.mean, x.std) == pytest.approx((filled.mean(), filled.std(ddof=0)))
    assert flat.divisor == 1.0
    even = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert fit_medians(even, ["v"])["v"] == 2.5
    empty = spark.createDataFrame([(None,)], "v double")
    assert fit_medians(empty, ["v"])["v"] == 0.0


def test_mode_ties_and_unseen_values(spark):
    train_rows = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    (fit,) = fit_categories(train_rows, ["c"])
    assert (fit.mode, fit.categories) == ("a", ("a", "b"))
    other = spark.createDataFrame([("zzz",), (None,), ("b",)], "c string")
    assert [tuple(r) for r in impute_onehot(other, [fit]).collect()] == [(0, 0), (1, 0), (0, 1)]
    with pytest.raises(ValueError, match="categories"):
        fit_categories(train_rows, ["c"], max_categories=1)


@pytest.mark.parametrize("rows_per_part", [3, 100_000])
def test_sparse_rows_are_the_dense_columns(spark, rows_per_part):
    rows = [(i, None if i % 9 == 0 else f"v{i % 13}", ["b", "a", "é", None][i % 4]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, p string, q string")
    seen = df.filter("id < 150 AND p <> 'v12'")
    dictionary = category_dictionary(seen, ["p", "q"], rows_per_part)
    order = [(r["feature"], r["value"]) for r in dictionary.orderBy("index").collect()]
    assert order == sorted(order) and [r["index"] for r in dictionary.orderBy("index").collect()] == list(range(len(order)))
    dense = impute_onehot(df, fit_categories(seen, ["p", "q"])).orderBy("id").toPandas()
    want = {(r["id"], j) for _, r in dense.iterrows() for j, (f, v) in enumerate(order) if r[f"{f}_{v}"] == 1}
    got = encode_sparse(df, ["p", "q"], dictionary, ["id"]).collect()
    assert {(r["id"], r["index"]) for r in got} == want and len(got) == len(want)
    assert category_dictionary(df.limit(0), ["p"]).count() == 0


def _matrix(df):
    fit = fit_features(df, SPEC)
    wide = impute_onehot(impute_scale(df, fit.numeric), fit.categorical).orderBy("id")
    names = [*SPEC.numeric, *[f"{f.name}_{c}" for f in fit.categorical for c in f.categories]]
    return fit, wide.select(*[F.col(f"`{n}`") for n in names], "label").toPandas().to_numpy(float)


def test_stages_equal_explicit_columns(mixed):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    fit, explicit = _matrix(mixed)
    staged = Pipeline(stages=feature_stages(fit, mixed.schema)).fit(mixed).transform(mixed).orderBy("id")
    vectors = np.array([r[0] for r in staged.select(vector_to_array("features")).collect()])
    assert vectors.shape == (400, fit.width)
    assert np.allclose(vectors, explicit[:, :-1])


def test_coefficients_match_newton(mixed):
    _, data = _matrix(mixed)
    x, y = np.hstack([data[:, :-1], np.ones((len(data), 1))]), data[:, -1]
    n = len(y)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    penalty = np.ones(x.shape[1])
    penalty[-1] = 0
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (w * (p - y)) + penalty * beta
        hessian = (x.T * (w * p * (1 - p))) @ x + np.diag(penalty)
        beta -= np.linalg.solve(hessian, gradient)
    model = train(mixed, SPEC, ModelOptions(tol=1e-12))
    classifier = model.stages[-1]
    found = np.append(classifier.coefficients.toArray(), classifier.intercept)
    assert np.allclose(found, beta, atol=1e-5)
    linear = train(mixed, SPEC, ModelOptions(solver="newton")).stages[-2]
    found = np.append(linear.coefficients.toArray(), linear.intercept)
    assert np.allclose(found, beta, atol=1e-6)  # a flat feature keeps the Gram matrix singular
    narrow = FeatureSpec(("x", "z"), ("c", "d"))
    linear = train(mixed, narrow, ModelOptions(solver="newton")).stages[-2]
    found = np.append(linear.coefficients.toArray(), linear.intercept)
    assert np.allclose(found, np.delete(beta, 2), atol=1e-10)


def test_newton_model_is_stored_whole(mixed, tmp_path):
    from pyspark.ml import PipelineModel

    options = ModelOptions(solver="newton", C=0.3)
    model = train(mixed, SPEC, options)
    rows = score(model, mixed, options).orderBy("id").collect()
    model.write().save(str(tmp_path / "m"))
    again = score(PipelineModel.load(str(tmp_path / "m")), mixed, options).orderBy("id").collect()
    assert again == rows
    other = score(train(mixed, SPEC, ModelOptions(C=0.3, tol=1e-12)), mixed).orderBy("id").collect()
    assert np.allclose([r["probability"] for r in rows], [r["probability"] for r in other], atol=1e-5)
    assert [r["predicted_class"] for r in rows] == [r["predicted_class"] for r in other]
    with pytest.raises(ValueError, match="solver"):
        ModelOptions(solver="sag")
    with pytest.raises(ArithmeticError, match="steps"):
        train(mixed, SPEC, ModelOptions(solver="newton", max_iter=2))


def test_scoring_echoes_the_threshold(spark, mixed, tmp_path):
    from pyspark.ml import PipelineModel

    model = train(mixed, SPEC)
    options = ModelOptions(decision_threshold=0.9)
    rows = score(model, mixed, options).collect()
    assert all(r["predicted_class"] == int(r["probability"] > 0.5) for r in rows)
    assert all(r["decision_threshold"] == 0.9 for r in rows)
    applied = score(model, mixed, options, apply_threshold=True).collect()
    assert all(r["predicted_class"] == int(r["probability"] >= 0.9) for r in applied)
    model.write().save(str(tmp_path / "m"))
    again = score(PipelineModel.load(str(tmp_path / "m")), mixed, options).collect()
    assert sorted(r["probability"] for r in again) == sorted(r["probability"] for r in rows)
    placed = prediction_rows(
        score(model, mixed.withColumn("q", F.col("id") % 3)), "q", "id", {"model_name": "m"}
    )
    assert placed.filter("index = 0").count() == 3
    assert placed.agg(F.max("index")).first()[0] == 133


def _brute(y, s):
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall = y[hit].sum() / y.sum()
        ap += (recall - last) * y[hit].mean()
        last = recall
    return auc, ap


@pytest.mark.parametrize("edges", [[], [0.1, 0.2, 0.35, 0.5, 0.8]])
def test_ranking_metrics(spark, edges):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"split": rng.choice(["a", "b"], 300), "label": rng.integers(0, 2, 300),
                        "probability": rng.random(300).round(2)})
    df = spark.createDataFrame(pdf)
    found = {r["split"]: r for r in ranking_metrics(df, ["split"], edges=edges).collect()}
    for name, g in pdf.groupby("split"):
        auc, ap = _brute(g.label.to_numpy(), g.probability.to_numpy())
        assert found[name]["roc_auc"] == pytest.approx(auc, abs=1e-12)
        assert found[name]["average_precision"] == pytest.approx(ap, abs=1e-12)
    flipped = df.withColumn("probability", 1 - F.col("probability"))
    for r in ranking_metrics(flipped, ["split"]).collect():
        assert r["roc_auc"] == pytest.approx(1 - found[r["split"]]["roc_auc"], abs=1e-12)


def test_metrics_without_values(spark):
    df = spark.createDataFrame(
        [("one", 1, 1, 0.9), ("one", 1, 0, 0.2), ("none", 0, 0, 0.1), ("gap", 1, 1, None), ("gap", 0, 0, None)],
        "split string, label int, predicted_class int, probability double",
    )
    rows = {r["split"]: r for r in classification_metrics(df).collect()}
    assert rows["one"]["roc_auc"] is None and rows["one"]["average_precision"] == 1.0
    assert rows["none"]["average_precision"] is None and rows["none"]["precision"] == 0.0
    assert rows["gap"]["roc_auc"] is None and rows["gap"]["accuracy"] == 1.0
    long = metrics_long(classification_metrics(df))
    assert long.filter("metric = 'support' and split = 'gap'").first()["value"] == 2.0
    # one class: AUC; no positives: AUC and AP; no scores: AUC and AP
    assert long.filter("value is null").count() == 5


def _watched(spark, rows, schema):
    """A table and the number of rows that were read from it so far."""
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return spark.createDataFrame(rows, schema).mapInPandas(passed, schema), seen


def test_metrics_read_scores_once(spark):
    rows = [("ab"[i % 2], i % 3 % 2, i % 7 / 7, int(i % 7 > 3)) for i in range(300)]
    scored, seen = _watched(spark, rows, "split string, label int, probability double, predicted_class int")
    got = {r["split"]: r for r in classification_metrics(scored).collect()}
    assert seen.value == len(rows)
    assert got["a"]["support"] == 150 and 0 < got["a"]["roc_auc"] < 1


def test_splits_of_large_classes_read_rows_twice(spark):
    df, seen = _watched(spark, [(i, i % 2) for i in range(2_000)], "id long, label int")
    split = assign_splits(df, "label", "id", SplitOptions(test_size=0.2, validation_size=0.1, seed=1), rows_per_cell=50)
    sizes = [{r["split"]: r["count"] for r in split.groupBy("split").count().collect()} for _ in range(2)]
    assert sizes == [{"train": 1400, "validation": 200, "test": 400}] * 2
    # for the counts of the classes and for the cells; not again by what uses the splits
    assert seen.value == 4_000
