"""Exact quantiles of many columns without sorting a column in one task.

The value at a rank is found by narrowing: points on the number line cut each
column into open intervals and single values, one job counts the rows of every
region, and only intervals that hold a wanted rank and are still larger than
``collect_limit`` are cut again at approximate quantiles of their own rows. A
value that fills a large share of the rows ends up as a point of its own, so
ties never pile up in an interval. The last job groups the few rows left in the
wanted intervals by value; where the points promise short intervals, it is the
job that counts. Ranks are integers, so no rounding enters.

Approximate quantiles come from mergeable sketches: each task sketches its rows,
groups of tasks are merged first, and the last step merges one sketch a group.
"""

from __future__ import annotations

import bisect
import itertools
import math
import sys
from collections.abc import Callable, Mapping, Sequence
from fractions import Fraction

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.local import small_table

COLLECT_LIMIT = 50_000
#: Size of a sketch, and how many sketches meet in the last step of a merge.
SKETCH_K = 4_096
MERGE_GROUPS = 64
LARGEST = sys.float_info.max


def rank_error(k: int) -> float:
    """Error of a sketch's ranks as a share of the rows, at a confidence of 0.99 (published bound)."""
    return 2.296 / k**0.9021


def sketch_quantiles(
    df: DataFrame, asked: Sequence[tuple[Column, Sequence[float]]], k: int = SKETCH_K, also: Sequence[Column] = ()
) -> tuple[list[list[float]], list]:
    """Approximate quantiles of columns at shares of their rows, in one job.

    Also the sums of the aggregates ``also`` over the groups of tasks. A column
    without values has no quantiles.
    """
    part = F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("__part")
    rows = df.select(part, *[c.cast("double").alias(f"__q{i}") for i, (c, _) in enumerate(asked)])
    grouped = rows.groupBy("__part").agg(
        *[F.kll_sketch_agg_double(f"__q{i}", F.lit(k)).alias(f"__q{i}") for i in range(len(asked))],
        *[c.alias(f"__a{i}") for i, c in enumerate(also)])
    merged = grouped.agg(
        *[F.kll_merge_agg_double(F.when(F.kll_sketch_get_n_double(f"__q{i}") > 0, F.col(f"__q{i}")), F.lit(k)).alias(f"__q{i}")
          for i in range(len(asked))],
        *[F.sum(f"__a{i}").alias(f"__a{i}") for i in range(len(also))])
    row = merged.select(
        *[F.when(F.kll_sketch_get_n_double(f"__q{i}") > 0, F.kll_sketch_get_quantile_double(
            f"__q{i}", F.array(*[F.lit(min(1.0, max(0.0, float(x)))) for x in shares]))).alias(f"__q{i}")
          for i, (_, shares) in enumerate(asked)],
        *[f"__a{i}" for i in range(len(also))]).first()
    return [list(row[f"__q{i}"] or []) for i in range(len(asked))], [row[f"__a{i}"] for i in range(len(also))]


def _cells(
    df: DataFrame, columns: Mapping[str, Column], points: Mapping[str, list[float]]
) -> DataFrame:
    """Value ``v<i>`` and region ``r<i>`` of every column.

    Even regions are the open intervals between points, odd ones the points.
    The place among the points is found by binary search.
    """
    # adding 0.0 makes both zeros one value; infinities become the largest numbers
    values = df.select(
        *[
            F.greatest(F.least(v.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST)).alias(f"w{i}")
            for i, v in enumerate(columns.values())
        ]
    ).select(*[(F.col(f"w{i}") + F.lit(0.0)).alias(f"v{i}") for i in range(len(columns))])
    cut = {i: points[n] for i, n in enumerate(columns) if points[n]}
    if cut:
        values = Bucketizer(
            splitsArray=[[float("-inf"), *p, float("inf")] for p in cut.values()],
            inputCols=[f"v{i}" for i in cut],
            outputCols=[f"b{i}" for i in cut],
            handleInvalid="keep",
        ).transform(values)
    regions = []
    for i in range(len(columns)):
        region = F.lit(0)
        if i in cut:
            reached = F.col(f"b{i}").cast("int")
            point = F.get(F.array(*[F.lit(p) for p in cut[i]]), reached - 1)
            on_point = F.coalesce(point == F.col(f"v{i}"), F.lit(False))
            region = F.lit(2) * reached - on_point.cast("int")
        regions.append(region.alias(f"r{i}"))
    return values.select(*[F.col(f"v{i}") for i in range(len(columns))], *regions)


def _wanted_ranks(count: int, shares: Sequence[Fraction]) -> set[int]:
    ranks = set()
    for share in shares:
        low = (count - 1) * share.numerator // share.denominator
        ranks.update({low, min(low + 1, count - 1)})
    return ranks


def _locate(counts: Mapping[int, int], ranks: set[int]) -> dict[int, list[tuple[int, int]]]:
    """Region number -> [(rank, rank inside the region)]."""
    found: dict[int, list[tuple[int, int]]] = {}
    below = 0
    pending = sorted(ranks)
    for region in sorted(counts):
        while pending and pending[0] < below + counts[region]:
            found.setdefault(region, []).append((pending[0], pending.pop(0) - below))
        below += counts[region]
    return found


def _long(
    df: DataFrame, columns: Mapping[str, Column], points: Mapping[str, list[float]]
) -> DataFrame:
    cells = [
        F.struct(
            F.lit(name).alias("feature"), F.col(f"r{i}").alias("region"), F.col(f"v{i}").alias("value")
        )
        for i, name in enumerate(columns)
    ]
    return (
        _cells(df, columns, points)
        .select(F.inline(F.array(*cells)))
        .filter(F.col("value").isNotNull())
    )


def _narrow(
    df: DataFrame,
    columns: Mapping[str, Column],
    points: Mapping[str, list[float]],
    wide: Mapping[tuple[str, int], tuple[int, list[int]]],
) -> tuple[dict[str, list[float]], dict[str, list[tuple[float, float]]], float]:
    """New cut points around the wanted ranks, the brackets they form, and the rows in these."""
    place = {n: i for i, n in enumerate(columns)}
    margin = 1.5 * rank_error(SKETCH_K)
    asked = []
    for (name, region), (count, ranks) in wide.items():
        i = place[name]
        sides = [s for r in ranks for s in ((r + 0.5) / count - margin, (r + 0.5) / count + margin)]
        asked.append((F.when(F.col(f"r{i}") == region, F.col(f"v{i}")), sides))
    found, _ = sketch_quantiles(_cells(df, columns, points), asked)
    fresh: dict[str, list[float]] = {}
    brackets: dict[str, list[tuple[float, float]]] = {}
    rows = 0.0
    for ((name, _), (count, ranks)), values in zip(wide.items(), found, strict=True):
        fresh.setdefault(name, []).extend(values)
        brackets.setdefault(name, []).extend(zip(values[::2], values[1::2], strict=True))
        rows += 2 * margin * count * len(ranks)
    return fresh, brackets, rows


def _count_values(
    df: DataFrame,
    columns: Mapping[str, Column],
    points: Mapping[str, list[float]],
    brackets: Mapping[str, list[tuple[float, float]]],
) -> tuple[dict[str, dict[int, int]], dict[tuple[str, int], dict[float, int]]]:
    """Rows per region, and per value in the intervals inside brackets."""
    inside: dict[str, set[int]] = {}
    for name, pairs in brackets.items():
        for low, high in pairs:
            first, last = bisect.bisect_left(points[name], low), bisect.bisect_left(points[name], high)
            inside.setdefault(name, set()).update(2 * (i + 1) for i in range(first, last))
    keep = F.lit(False)
    for name, found in inside.items():
        if found:
            keep = keep | ((F.col("feature") == name) & F.col("region").isin(sorted(found)))
    grouped = _long(df, columns, points).groupBy(
        "feature", "region", F.when(keep, F.col("value")).alias("value")).agg(F.count("*").alias("n"))
    regions: dict[str, dict[int, int]] = {n: {} for n in columns}
    values: dict[tuple[str, int], dict[float, int]] = {}
    for r in grouped.collect():
        regions[r["feature"]][r["region"]] = regions[r["feature"]].get(r["region"], 0) + r["n"]
        if r["value"] is not None:
            values.setdefault((r["feature"], r["region"]), {})[r["value"]] = r["n"]
    return regions, values


def exact_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    shares: Mapping[str, Sequence[Fraction]],
    counts: Mapping[str, int],
    collect_limit: int = COLLECT_LIMIT,
) -> dict[str, list[float]]:
    """Linearly interpolated quantiles of numeric columns, in the order of ``shares``.

    ``counts`` are the non-null row counts, which callers know from a profile.
    """
    names = [n for n in columns if counts.get(n, 0) > 0 and shares.get(n)]
    columns = {n: columns[n] for n in names}
    ranks = {n: _wanted_ranks(counts[n], shares[n]) for n in names}
    points: dict[str, list[float]] = {n: [] for n in names}
    regions = {n: {0: counts[n]} for n in names}
    values: dict[tuple[str, int], float] = {}
    spelled: dict[tuple[str, int], dict[float, int]] = {}

    while True:
        located = {n: _locate(regions[n], ranks[n]) for n in names}
        wide = {
            (n, region): (regions[n][region], [local for _, local in hits])
            for n in names
            for region, hits in located[n].items()
            if region % 2 == 0 and regions[n][region] > collect_limit and (n, region) not in spelled
        }
        if not wide:
            break
        fresh, brackets, inside = _narrow(df, columns, points, wide)
        points = {n: sorted({*points[n], *fresh.get(n, [])}) for n in names}
        spelled = {}
        if inside <= collect_limit:
            regions, spelled = _count_values(df, columns, points, brackets)
            continue
        table = _long(df, columns, points).groupBy("feature", "region").count().collect()
        regions = {n: {r["region"]: r["count"] for r in table if r["feature"] == n} for n in names}

    targets = []
    for n in names:
        for region, hits in located[n].items():
            for rank, local in hits:
                if region % 2:
                    values[n, rank] = points[n][region // 2]
                elif (n, region) in spelled:
                    values[n, rank] = _at_rank(spelled[n, region], local)
                else:
                    targets.append((n, region, rank, local))
    if targets:
        values.update(_pick(df, columns, points, targets))

    values = {k: math.copysign(math.inf, v) if abs(v) == LARGEST else v for k, v in values.items()}

    return {
        n: [_interpolate(counts[n], s, lambda rank: values[n, rank]) for s in shares[n]] for n in names
    }


def _interpolate(count: int, share: Fraction, value_at: Callable[[int], float]) -> float:
    low, rest = divmod((count - 1) * share.numerator, share.denominator)
    a = value_at(low)
    if rest == 0:
        return a
    b = value_at(min(low + 1, count - 1))
    return a if a == b else a + (b - a) * (rest / share.denominator)


def _at_rank(counts: Mapping[float, int], rank: int) -> float:
    values = sorted(counts)
    return values[bisect.bisect_right(list(itertools.accumulate(counts[v] for v in values)), rank)]


def quantiles_of_counts(counts: Mapping[float, int], shares: Sequence[Fraction]) -> list[float]:
    """The same quantiles from the counts of a few distinct values."""
    values = sorted(counts)
    upto = list(itertools.accumulate(counts[v] for v in values))
    return [_interpolate(upto[-1], s, lambda rank: values[bisect.bisect_right(upto, rank)]) for s in shares]


def _pick(
    df: DataFrame,
    columns: Mapping[str, Column],
    points: Mapping[str, list[float]],
    targets: list[tuple[str, int, int, int]],
) -> dict[tuple[str, int], float]:
    """Read the values at local ranks of intervals that are small enough."""
    wanted = sorted({(n, region) for n, region, _, _ in targets})
    keep = F.lit(False)
    for n, region in wanted:
        keep = keep | ((F.col("feature") == n) & (F.col("region") == region))
    grouped = _long(df, columns, points).filter(keep).groupBy("feature", "region", "value").count()
    order = Window.partitionBy("feature", "region").orderBy("value")
    upto = grouped.withColumn("upto", F.sum("count").over(order))
    asked = small_table(
        df.sparkSession, targets, "t_feature string, t_region int, rank bigint, local bigint"
    )
    hit = (
        (F.col("feature") == F.col("t_feature"))
        & (F.col("region") == F.col("t_region"))
        & (F.col("local") < F.col("upto"))
        & (F.col("local") >= F.col("upto") - F.col("count"))
    )
    # at most two ranks per requested quantile, so the broadcast side is bounded by the request
    rows = upto.join(F.broadcast(asked), hit).select("feature", "rank", "value").collect()
    return {(r["feature"], r["rank"]): r["value"] for r in rows}
