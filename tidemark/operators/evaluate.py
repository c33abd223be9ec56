"""Binary classification metrics for every split in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.plans.ordered import block_edges, running
from tidemark.session import stored

# --- fixed values -----------------------------------------------------------
METRICS = (
    "accuracy", "precision", "recall", "f1", "roc_auc", "average_precision", "support",
    "true_negatives", "false_positives", "false_negatives", "true_positives",
)
# ----------------------------------------------------------------------------


def _ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_metrics(
    df: DataFrame, by: Sequence[str], label: str = "label", predicted: str = "predicted_class"
) -> DataFrame:
    """Confusion counts and the ratios built on them; empty denominators give 0."""
    y, p = col(label), col(predicted)
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("support"),
        F.count_if((y == 0) & (p == 0)).alias("true_negatives"),
        F.count_if((y == 0) & (p == 1)).alias("false_positives"),
        F.count_if((y == 1) & (p == 0)).alias("false_negatives"),
        F.count_if((y == 1) & (p == 1)).alias("true_positives"),
    )
    tn, fp = F.col("true_negatives"), F.col("false_positives")
    fn, tp = F.col("false_negatives"), F.col("true_positives")
    return counts.withColumns(
        {
            "accuracy": _ratio(tp + tn, F.col("support")),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def ranking_metrics(
    df: DataFrame,
    by: Sequence[str],
    label: str = "label",
    score: str = "probability",
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """ROC AUC and average precision with exact handling of tied scores.

    Rows are first reduced to one row per distinct score; running counts over
    the scores then stay distributed through ordered blocks. A split with one
    class or without positives gives null, and so does a split in which a row
    has no score: a ranking of the others would not be its ranking.
    """
    y = col(label)
    usable = col(score).isNotNull() & ~F.isnan(col(score).cast("double"))
    scored = df.withColumn("__scored", usable)
    if edges is None:
        # blocks from the raw scores: reading one column beats grouping twice
        edges = block_edges(
            scored.filter("__scored").select(col(score).cast("double").alias("score")), "score"
        )
    # rows without a score are one group of their split, below all others
    groups = (
        scored.groupBy(
            *by, F.when(F.col("__scored"), col(score).cast("double")).otherwise(F.lit(float("-inf"))).alias("score"),
            "__scored",
        )
        .agg(
            F.count_if(y == 1).cast("double").alias("p"),
            F.count_if(y == 0).cast("double").alias("n"),
        )
    )
    counted = running(
        groups, by, "score", {"cp": ("sum", "p"), "cn": ("sum", "n")}, descending=True, edges=edges
    )
    p, n, cp, cn = (F.col(c) for c in ("p", "n", "cp", "cn"))
    whole = F.bool_and("__scored")
    return counted.groupBy(*by).agg(
        F.when(whole, F.try_divide(F.sum(n * (cp - p / 2)), F.sum(p) * F.sum(n))).alias("roc_auc"),
        F.when(whole, F.try_divide(F.sum(p * F.try_divide(cp, cp + cn)), F.sum(p))).alias("average_precision"),
    )


def classification_metrics(
    df: DataFrame,
    by: Sequence[str] = ("split",),
    label: str = "label",
    predicted: str = "predicted_class",
    score: str = "probability",
) -> DataFrame:
    """All metrics, one row per split; scores, which take a model to make, are made once and stored."""
    kept = stored(df.select(*[col(c) for c in dict.fromkeys((*by, label, predicted, score))]), "scores")
    return confusion_metrics(kept, by, label, predicted).join(
        ranking_metrics(kept, by, label, score), list(by), "left"
    )


def metrics_long(wide: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """``(split, metric, value)`` rows; metrics without a value keep a null."""
    return wide.unpivot(
        list(by), [F.col(m).cast("double").alias(m) for m in METRICS if m in wide.columns],
        "metric", "value",
    )
