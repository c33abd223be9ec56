"""Ordered computations that do not put a whole group into one task.

A window over a hot key runs in a single task. The functions here cut the
order column into blocks, summarize each (key, block), carry the summaries
across blocks, and run the real window inside one (key, block). Only the
block summaries of a key meet in one task, and their number is limited by
``MAX_BLOCKS`` however many rows the key has.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import col
from tidemark.plans.quantiles import sketch_quantiles
from tidemark.session import cut_lineage, stored

ROWS_PER_BLOCK = 500_000
MAX_BLOCKS = 8_192
#: Blocks that one small sketch can tell apart; beyond, a large one is made.
FIRST_BLOCKS = 512
LARGEST_K = 65_535
BLOCK = "__block"

_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


def block_edges(
    df: DataFrame, order: str | Column, rows_per_block: int = ROWS_PER_BLOCK, at_most: int | None = None,
    keys: Sequence[str] = (),
) -> list[float]:
    """Inner edges that cut the rows into blocks of about ``rows_per_block``.

    One job counts, a second sketches the order column where more blocks than one
    are needed; at most ``MAX_BLOCKS`` numbers come back. An empty list means one
    block is enough: none of ``keys`` holds more rows than that, however many keys
    there are. ``at_most``, a number of a key's rows the caller knows not to be
    exceeded, may tell so without reading.
    """
    if at_most is not None and at_most <= rows_per_block:
        return []
    # one row per key and task is moved
    sizes = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
    rows, most = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.max("__n"), F.lit(0))).first()
    if most <= rows_per_block:
        return []
    blocks = min(MAX_BLOCKS, -(-rows // rows_per_block))
    if blocks <= 1:
        return []
    key = col(order).cast("double")
    finite = F.when(~F.isnan(key) & (F.abs(key) != float("inf")), key)
    step = 1 / FIRST_BLOCKS
    if blocks <= FIRST_BLOCKS:
        # every so many edges of the even ones
        (edges,), _ = sketch_quantiles(
            df.select(finite.alias("key")), [(F.col("key"), [i * step for i in range(1, FIRST_BLOCKS)])])
        return sorted({edges[round(i * FIRST_BLOCKS / blocks) - 1] for i in range(1, blocks)} if edges else set())
    shares = [i / blocks for i in range(1, blocks)]
    (edges,), _ = sketch_quantiles(df.select(finite.alias("key")), [(F.col("key"), shares)], k=LARGEST_K)
    return sorted(set(edges))


def with_block(df: DataFrame, order: str | Column, edges: Sequence[float]) -> DataFrame:
    """Add the block number of each row: a monotone function of the order column."""
    if not edges:
        return df.withColumn(BLOCK, F.lit(0))
    place = Bucketizer(
        splits=[float("-inf"), *edges, float("inf")],
        inputCol="__order",
        outputCol="__place",
        handleInvalid="keep",
    )
    keyed = df.withColumn("__order", col(order).cast("double"))
    return (
        place.transform(keyed)
        .withColumn(BLOCK, F.col("__place").cast("int"))
        .drop("__order", "__place")
    )


def _descending(order: Column, descending: bool) -> Column:
    return order.desc() if descending else order.asc()


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    outputs: Mapping[str, tuple[str, str]],
    *,
    inclusive: bool = True,
    descending: bool = False,
    ties: Sequence[str] = (),
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """Running sum / max / min of columns per key, in the given order.

    ``outputs`` maps a new column to ``(function, column)``. Rows that tie on
    ``order`` are told apart by ``ties``; without them the order must be unique
    inside a key. Exclusive results are null on the first row.
    """
    edges = block_edges(df, order) if edges is None else edges
    placed = with_block(df, order, edges)
    sort = [_descending(c, descending) for c in (col(order), *[col(t) for t in ties])]
    frame = Window.partitionBy(*keys, BLOCK).orderBy(*sort)
    frame = frame.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inner = {
        name: _AGGREGATES[fn](col(source)).over(frame) for name, (fn, source) in outputs.items()
    }
    if not edges:
        return placed.withColumns(inner).drop(BLOCK)

    carried = {name: f"__carry_{i}" for i, name in enumerate(outputs)}
    summaries = placed.groupBy(*keys, BLOCK).agg(
        *[_AGGREGATES[fn](col(source)).alias(carried[n]) for n, (fn, source) in outputs.items()]
    )
    before = Window.partitionBy(*keys).orderBy(_descending(F.col(BLOCK), descending)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carry = summaries.select(
        *[col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col(BLOCK).alias("__carry_block"),
        *[_AGGREGATES[fn](F.col(carried[n])).over(before).alias(carried[n])
          for n, (fn, _) in outputs.items()],
    )
    same = F.col(BLOCK) == F.col("__carry_block")
    for i, k in enumerate(keys):
        same = same & col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = placed.withColumns({f"__in_{n}": c for n, c in inner.items()}).join(carry, same, "left")
    return joined.withColumns(
        {n: _combine(fn, F.col(carried[n]), F.col(f"__in_{n}")) for n, (fn, _) in outputs.items()}
    ).select(*[col(c) for c in df.columns if c not in outputs], *[col(n) for n in outputs])


def _combine(fn: str, carried: Column, inner: Column) -> Column:
    if fn == "sum":
        both = carried + inner
        return F.coalesce(both, carried, inner)
    return F.greatest(carried, inner) if fn == "max" else F.least(carried, inner)


def range_positions(
    df: DataFrame, order: Sequence[Column], name: str, rows: int, rows_per_part: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Position of every row from 0, in an order of any type, by range partitions.

    ``rows`` is a number of rows not to be exceeded. The dealt rows are stored in
    their order, as a partition computed again could get other rows.
    """
    dealt = _dealt(df, order, rows, rows_per_part)
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    # one row per range partition
    return (dealt.join(F.broadcast(before), "__part")
            .withColumn(name, (F.col("__before") + F.col("__inner")).cast("bigint"))
            .drop("__part", "__inner", "__before"))


def _dealt(df: DataFrame, order: Sequence[Column], rows: int, rows_per_part: int) -> DataFrame:
    """The rows with the range partition they are in and their place there, from 0."""
    parts = max(1, -(-rows // rows_per_part))
    # the number of a task's row: the task above bit 33, the row's place below
    numbered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(
        "__id", F.monotonically_increasing_id())
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return stored(numbered, "dealt").withColumns(
        {"__part": F.shiftright("__id", 33).cast("int"), "__inner": place}).drop("__id")


def _positions_of_any(
    df: DataFrame, keys: Sequence[str], order: str, name: str, ties: Sequence[str], rows_per_block: int
) -> DataFrame:
    """``positions`` in an order of any type: only keys with many rows are dealt to range partitions."""
    sort = [col(order).asc(), *[col(t).asc() for t in ties]]
    window = Window.partitionBy(*[col(k) for k in keys]).orderBy(*sort)
    plain = F.row_number().over(window).cast("bigint")
    sizes = df.groupBy(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__n"))
    large = cut_lineage(sizes.filter(F.col("__n") > rows_per_block))
    rows = large.agg(F.sum("__n")).first()[0]
    if not rows:
        return df.withColumn(name, plain)

    def same(others: DataFrame) -> Column:
        return functools.reduce(
            operator.and_, [col(k).eqNullSafe(others[f"__k{i}"]) for i, k in enumerate(keys)], F.lit(True))

    marks = F.broadcast(large.drop("__n"))
    light = df.join(marks, same(marks), "left_anti").withColumn(name, plain)
    dealt = _dealt(df.join(marks, same(marks), "left_semi"), [*[col(k).asc() for k in keys], *sort], rows, rows_per_block)
    # a row per key and range partition; a partition holds its keys one after the other
    counts = dealt.groupBy(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__inner").alias("__first"))
    ahead = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__p").rowsBetween(
        Window.unboundedPreceding, -1)
    before = F.broadcast(counts.withColumn("__before", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).drop("__n"))
    placed = dealt.join(before, same(before) & (F.col("__part") == F.col("__p"))).withColumn(
        name, (F.col("__before") + F.col("__inner") - F.col("__first") + 1).cast("bigint"))
    return light.unionByName(placed.select(*[col(c) for c in light.columns]))


def _blocks_fit(df: DataFrame, order: str) -> bool:
    """Whether edges of blocks, which are doubles, can cut the order column."""
    kind = df.schema[order].dataType
    return isinstance(kind, (T.NumericType, T.TimestampType))


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str,
    *,
    ties: Sequence[str] = (),
    edges: Sequence[float] | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Dense 1-based position of each row inside its key; the order may be of any type."""
    if edges is None and not _blocks_fit(df, order):
        return _positions_of_any(df, keys, order, name, ties, rows_per_block)
    one = df.withColumn("__one", F.lit(1).cast("bigint"))
    return running(one, keys, order, {name: ("sum", "__one")}, ties=ties, edges=edges).drop("__one")


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    source: str,
    name: str,
    *,
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """Value of ``source`` on the row before, per key; null on the first row."""
    edges = block_edges(df, order) if edges is None else edges
    placed = with_block(df, order, edges)
    inner = Window.partitionBy(*keys, BLOCK).orderBy(col(order))
    local = placed.withColumns(
        {name: F.lag(col(source)).over(inner), "__first": F.row_number().over(inner) == 1}
    )
    if not edges:
        return local.drop(BLOCK, "__first")
    lasts = placed.groupBy(*keys, BLOCK).agg(F.max_by(col(source), col(order)).alias("__last"))
    carry = lasts.select(
        *[col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col(BLOCK).alias("__carry_block"),
        F.lag("__last").over(Window.partitionBy(*keys).orderBy(BLOCK)).alias("__carried"),
    )
    same = F.col(BLOCK) == F.col("__carry_block")
    for i, k in enumerate(keys):
        same = same & col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = local.join(carry, same, "left")
    value = F.when(F.col("__first"), F.col("__carried")).otherwise(col(name))
    return joined.withColumn(name, value).select(*[col(c) for c in df.columns], col(name))
