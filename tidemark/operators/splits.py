"""Exact stratified train / validation / test assignment."""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col
from tidemark.options import SplitOptions
from tidemark.plans.local import small_table
from tidemark.plans.lookup import lookup_join
from tidemark.plans.ordered import positions, running
from tidemark.session import cut_lineage, stored

ROWS_PER_CELL = 200_000
MAX_DIGITS = 6
CELLS_PER_BLOCK = 65_536
#: Classes whose counts the driver takes.
FEW_CLASSES = 10_000


def _sizes(total: int, classes: int, least: int, fraction: float, what: str) -> tuple[int, int]:
    """Rows held out of a split and rows kept; an error where a class would get none."""
    held = math.ceil(total * fraction)
    kept = total - held
    if held < 1 or kept < 1 or (classes > 1 and (least < 2 or held < classes or kept < classes)):
        raise ValueError(f"cannot take the {what} split: a class has too few rows")
    return held, kept


def _held_out_few(counts: list[int], fraction: float, what: str) -> list[int]:
    """``_held_out`` for counts in the order of their classes."""
    total = sum(counts)
    _, kept = _sizes(total, len(counts), min(counts, default=0), fraction, what)
    shares = [n * kept // total for n in counts]
    by_rest = sorted(range(len(counts)), key=lambda i: (-(counts[i] * kept % total), i))
    first = set(by_rest[: kept - sum(shares)])
    return [n - share - (i in first) for i, (n, share) in enumerate(zip(counts, shares, strict=True))]


def _held_out(classes: DataFrame, fraction: float, what: str) -> DataFrame:
    """``label, held``: rows of each class that are held out of a split.

    The rows kept are dealt by largest remainders, ties to the smaller class.
    ``classes`` is ``label, n``; only totals come to the driver.
    """
    seen = classes.agg(F.sum("n").alias("rows"), F.count("n").alias("classes"), F.min("n").alias("least")).first()
    total = seen["rows"] or 0
    _, kept = _sizes(total, seen["classes"], seen["least"], fraction, what)
    wide = "CAST(n AS DECIMAL(38, 0)) * CAST(%d AS DECIMAL(38, 0))" % kept
    shares = classes.withColumns(
        {
            "share": F.expr(f"({wide}) div {total}").cast("bigint"),
            "order": -F.expr(f"({wide}) % {total}").cast("bigint"),
        }
    )
    left = kept - shares.agg(F.sum("share")).first()[0]
    ranked = positions(shares, [], "order", "place", ties=["label"])
    extra = (F.col("place") <= left).cast("bigint")
    return ranked.select("label", (F.col("n") - F.col("share") - extra).alias("held"))


def split_quotas(classes: DataFrame, options: SplitOptions) -> DataFrame:
    """``label, n, test, validation`` rows per class, from ``label, n``.

    Up to ``FEW_CLASSES`` classes are a list, whose quotas take no job; more stay a table.
    """
    few = classes.select("label", "n").orderBy("label").limit(FEW_CLASSES + 1).collect()
    if len(few) > FEW_CLASSES:
        return _quota_table(classes, options)
    counts = [r["n"] for r in few]
    test = _held_out_few(counts, options.test_size, "test")
    validation = [0] * len(few)
    if options.validation_size:
        pool = [i for i, n in enumerate(counts) if n > test[i]]
        share = options.validation_size / (1 - options.test_size)
        held = _held_out_few([counts[i] - test[i] for i in pool], share, "validation")
        for i, n in zip(pool, held, strict=True):
            validation[i] = n
    fields = [classes.schema["label"], *(T.StructField(n, T.LongType()) for n in ("n", "test", "validation"))]
    rows = [(r["label"], *sizes) for r, *sizes in zip(few, counts, test, validation, strict=True)]
    return small_table(classes.sparkSession, rows, T.StructType(fields))


def _quota_table(classes: DataFrame, options: SplitOptions) -> DataFrame:
    test = _held_out(classes, options.test_size, "test")
    quotas = classes.join(test.withColumnRenamed("held", "test"), "label")
    if options.validation_size == 0:
        return cut_lineage(quotas.withColumn("validation", F.lit(0).cast("bigint")))
    quotas = cut_lineage(quotas)
    pool = quotas.filter(F.col("n") > F.col("test")).select("label", (F.col("n") - F.col("test")).alias("n"))
    share = options.validation_size / (1 - options.test_size)
    validation = _held_out(pool, share, "validation").withColumnRenamed("held", "validation")
    return cut_lineage(quotas.join(validation, "label", "left").withColumn(
        "validation", F.coalesce("validation", F.lit(0).cast("bigint"))
    ))


def _named(rank: Column, test: Column, validation: Column) -> Column:
    return (
        F.when(rank <= test, "test")
        .when(rank <= test + validation, "validation")
        .otherwise("train")
    )


def assign_splits(
    df: DataFrame,
    label: str,
    row_id: str,
    options: SplitOptions,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Add ``split``: rows of a class are ranked by a seeded hash of their id.

    The first hash digits cut a class into cells of equal expected size. Cell
    counts tell where the quotas fall, so every row outside the one or two
    boundary cells of its class is decided by comparing digits, without any
    shuffle of rows; only boundary cells are ranked. Rows of large classes are
    stored with their cells once.
    """
    classes = cut_lineage(df.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")))
    if classes.isEmpty():
        raise ValueError("cannot split an empty table")
    quotas = split_quotas(classes, options)
    sizes = quotas.agg(F.max("n").alias("largest"), F.count(F.lit(1)).alias("classes")).first()
    digits = 0
    while digits < MAX_DIGITS and sizes["largest"] > rows_per_cell * 16**digits:
        digits += 1

    digest = F.md5(F.concat(F.lit(f"{options.seed}|"), col(row_id).cast("string")))
    if digits:
        # everything after reads the rows with their cells; digests are made again in boundary cells only
        hashed = stored(
            df.withColumn("__cell", F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")), "cells")
    else:
        hashed = df.withColumn("__cell", F.lit(0).cast("bigint"))

    zero = F.lit(0).cast("bigint")
    plan = quotas.select(
        F.col("label").alias("__label"), F.col("test").alias("__test"), F.col("validation").alias("__val"),
        (F.col("test") + F.col("validation")).alias("__both"),
    )
    if digits:
        cells = hashed.groupBy(col(label).alias("label"), "__cell").agg(F.count(F.lit(1)).alias("n"))
        # hashes are uniform, so even steps over the cell numbers are even blocks
        steps = [float(c) for c in range(CELLS_PER_BLOCK, 16**digits, CELLS_PER_BLOCK)]
        upto = running(cells, ["label"], "__cell", {"upto": ("sum", "n")}, edges=steps)
        wanted = quotas.select(
            "label", F.explode(F.array_distinct(F.array(F.col("test"), F.col("test") + F.col("validation")))).alias("quota")
        )
        hit = cut_lineage(
            lookup_join(upto, wanted, ["label"], spread_by=["__cell"], at_most=2 * sizes["classes"]).filter(
                (F.col("quota") <= F.col("upto")) & (F.col("quota") > F.col("upto") - F.col("n"))
            ).select("label", "quota", "__cell", (F.col("upto") - F.col("n")).alias("below"))
        )
        for k, quota in ((1, "__test"), (2, "__both")):
            edge = hit.select(
                F.col("label").alias("__l"), F.col("quota").alias("__q"),
                F.col("__cell").alias(f"__c{k}"), F.col("below").alias(f"__b{k}"),
            )
            plan = plan.join(
                edge, F.col("__label").eqNullSafe(F.col("__l")) & (F.col(quota) == F.col("__q")), "left"
            ).drop("__l", "__q").withColumns(
                {f"__c{k}": F.coalesce(f"__c{k}", F.lit(-1).cast("bigint")), f"__b{k}": F.coalesce(f"__b{k}", zero)}
            )
    else:
        plan = plan.withColumns({"__c1": zero, "__b1": zero, "__c2": zero, "__b2": zero})
    keyed = hashed.withColumn("__label", col(label))
    planned = lookup_join(keyed, plan.drop("__both"), ["__label"], spread_by=[row_id], at_most=sizes["classes"])
    cell = F.col("__cell")
    on_edge = (cell == F.col("__c1")) | (cell == F.col("__c2"))
    out = [col(c) for c in df.columns]

    plain = planned.filter(~on_edge).select(
        *out,
        F.when(cell < F.col("__c1"), "test")
        .when(cell < F.col("__c2"), "validation")
        .otherwise("train")
        .alias("split"),
    )
    rank = F.row_number().over(
        Window.partitionBy(col(label), "__cell").orderBy(digest, col(row_id))
    ) + F.when(cell == F.col("__c1"), F.col("__b1")).otherwise(F.col("__b2"))
    ranked = planned.filter(on_edge).select(
        *out, _named(rank, F.col("__test"), F.col("__val")).alias("split")
    )
    return ranked if not digits else plain.unionByName(ranked)


def split_sizes(df: DataFrame, by: tuple[str, ...] = ("split",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"))
