"""Bucket indexes and the population stability index as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
PROBABILITY_FLOOR = 1e-6
# ----------------------------------------------------------------------------
MAX_UNROLL = 32


def numeric_bucket(value: Column, cuts: Column, unroll: int | None = None) -> Column:
    """0 for missing, else 1 + number of cut points below the value.

    Buckets are closed on the right: a value equal to a cut stays below it.
    With ``unroll`` (an upper bound of the array length) the count becomes plain
    compiled comparisons. Their code grows with the bound, so this pays where
    the expression occurs once, as on (feature, value) rows, not once per column.
    """
    if unroll is not None and unroll <= MAX_UNROLL:
        terms = [F.when(value > F.get(cuts, F.lit(i)), 1).otherwise(0) for i in range(unroll)]
        below = reduce(lambda a, b: a + b, terms, F.lit(0))
    else:
        below = F.size(F.filter(cuts, lambda c: value > c))
    return F.when(value.isNull(), F.lit(0)).otherwise(F.lit(1) + below)


def category_bucket(value: Column, labels: Column) -> Column:
    """Place of the value among ``labels``, counted from 0, or one past their end.

    ``labels`` are the missing bucket followed by the tracked categories. The
    remainder sends the 0 of "not found" to the last bucket, so the value, which
    may be costly to normalize, is written and evaluated once.
    """
    place = F.array_position(labels, value).cast("int")
    return F.pmod(place - 1, F.size(labels) + 1)


def psi_term(expected: Column, observed: Column) -> Column:
    e = F.greatest(expected, F.lit(PROBABILITY_FLOOR))
    o = F.greatest(observed, F.lit(PROBABILITY_FLOOR))
    return (o - e) * F.log(o / e)


def psi_of_columns(expected: Column, observed: Sequence[Column]) -> Column:
    """PSI of an expected array against one observed column per bucket.

    Bucket columns past the end of ``expected`` do not belong to the feature.
    """
    total = F.lit(0.0)
    for i, share in enumerate(observed):
        e = F.get(expected, F.lit(i))
        total = total + F.when(e.isNotNull(), psi_term(e, share)).otherwise(F.lit(0.0))
    return total


def psi_of_arrays(expected: Column, observed: Column) -> Column:
    """PSI of two aligned arrays; different lengths are an error."""
    terms = F.zip_with(expected, observed, psi_term)
    return F.when(
        F.size(expected) == F.size(observed),
        F.aggregate(terms, F.lit(0.0), lambda total, term: total + term),
    ).otherwise(
        F.raise_error(F.lit("expected and observed distributions differ in length")).cast("double")
    )


def feature_status(psi: Column, warning: float, drift: float) -> Column:
    return F.when(psi >= drift, "drift").when(psi >= warning, "warning").otherwise("stable")


def overall_status(drifted: Column, warned: Column, min_drifted: int) -> Column:
    return (
        F.when(drifted >= min_drifted, "drift_detected")
        .when((drifted > 0) | (warned > 0), "warning")
        .otherwise("stable")
    )
