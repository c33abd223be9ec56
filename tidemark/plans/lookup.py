"""Joining a large table with a dimension whose size is checked, not assumed."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.session import cut_lineage

BROADCAST_ROWS = 50_000
SALTS = 32
#: Rows of one key that are spread over tasks, and groups of keys that are counted to find it.
HEAVY_ROWS = 100_000
GROUPS = 1 << 16


def lookup_join(
    facts: DataFrame,
    dims: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] = (),
    broadcast_rows: int = BROADCAST_ROWS,
    at_most: int | None = None,
) -> DataFrame:
    """Equi-join that broadcasts ``dims`` only after counting it.

    ``at_most`` is an upper bound of its rows the caller has counted already.

    In a larger dimension only the keys that hold many of the facts are repeated,
    once per salt, and joined on key and salt, so that their facts are spread over
    many tasks; every other row is there once. ``spread_by`` are fact columns
    that vary inside a key.
    """
    if at_most is None:
        at_most = dims.limit(broadcast_rows + 1).count()
    if at_most <= broadcast_rows:
        return facts.join(F.broadcast(dims), list(keys), how)
    if not spread_by:
        return facts.join(dims, list(keys), how)
    heavy = heavy_keys(facts, keys)
    salt = F.pmod(F.xxhash64(*[col(c) for c in spread_by]), F.lit(SALTS)).cast("int")
    # facts without a key meet nothing, but may be many
    missing = [col(k).isNull() for k in keys]
    many = functools.reduce(operator.or_, missing, F.coalesce("__heavy", F.lit(False)))
    marked = heavy.withColumn("__heavy", F.lit(True))
    salted = facts.join(F.broadcast(marked), list(keys), "left").withColumn(
        "__salt", F.when(many, salt).otherwise(0)).drop("__heavy")
    salts = F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = dims.join(F.broadcast(marked), list(keys), "left").withColumn(
        "__salt", F.explode(salts)).drop("__heavy")
    return salted.join(repeated, [*keys, "__salt"], how).drop("__salt")


def heavy_keys(facts: DataFrame, keys: Sequence[str], least: int | None = None) -> DataFrame:
    """The keys that hold more than ``least`` rows, at most ``GROUPS`` of them.

    Rows are counted per group of keys first, which moves one number per group and
    task; only keys of groups that are large enough are counted themselves.
    """
    least = HEAVY_ROWS if least is None else least
    group = F.pmod(F.xxhash64(*[col(k) for k in keys]), F.lit(GROUPS)).cast("int")
    known = functools.reduce(operator.and_, [col(k).isNotNull() for k in keys])
    given = facts.filter(known).select(*[col(k) for k in keys], group.alias("__group"))
    sizes = cut_lineage(given.groupBy("__group").agg(F.count(F.lit(1)).alias("__n")))
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    # many keys make all groups large: a key counts as heavy above their mean
    least = max(least, total // GROUPS)
    large = sizes.filter(F.col("__n") > least).select("__group")
    counted = given.join(F.broadcast(large), "__group", "left_semi").groupBy(*[col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("__n"))
    return cut_lineage(counted.filter(F.col("__n") > least).drop("__n"))
