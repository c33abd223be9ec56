"""Connected components by contraction, in equi-joins and counted groups only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def _any(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every end of an edge: the smallest id it reaches.

    ``edges`` is a stored table with the long columns ``a`` and ``b``; order,
    repeats and loops do not matter. Every node hooks to its smallest neighbour, pointer jumping
    flattens the trees, the edges between trees are the next level. A level
    with edges left at least halves the trees that have any, so the number of
    joins grows with the logarithm of the nodes. No group is gathered: only
    minima are taken, and the joins can be split where a hub is hot.
    """
    edges = edges.filter("a <> b").select("a", "b")
    levels: list[DataFrame] = []
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut_lineage(
            both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least"))
            .select("id", F.least("id", "least").alias("up")))
        while True:  # two jumps at a time
            above = parent.select(F.col("id").alias("up"), F.col("up").alias("high"))
            higher = parent.select(F.col("id").alias("high"), F.col("up").alias("top"))
            moved = cut_lineage(parent.join(above, "up").join(higher, "high").select("id", "high", "top"))
            parent = moved.select("id", F.col("top").alias("up"))
            if not _any(moved.filter("high <> top")):
                break
        levels.append(parent)
        root_a = parent.select(F.col("id").alias("a"), F.col("up").alias("ra"))
        root_b = parent.select(F.col("id").alias("b"), F.col("up").alias("rb"))
        edges = cut_lineage(
            edges.join(root_a, "a").join(root_b, "b").filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if not _any(edges):
            break
    found = levels.pop()
    while levels:
        below = levels.pop()
        upper = found.select(F.col("id").alias("up"), F.col("up").alias("root"))
        found = below.join(upper, "up", "left").select("id", F.coalesce("root", "up").alias("up"))
    return found.select("id", F.col("up").alias("component"))
