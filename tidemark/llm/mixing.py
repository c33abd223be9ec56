"""Mixing sources to target weights by weighted sampling without replacement.

Every source has a share of all words by its weight, but no more than
``MOST_EPOCHS`` times its own words; what a source cannot take is shared by
the others, by weight again, until none is above its limit. A source first
gives whole epochs of all its documents. The words left are drawn as Efraimidis
and Spirakis do: a document with the quality weight w and a uniform number u
has the key -ln(u) / w, and documents are taken in the order of their keys
until the prefix sum of their sizes meets the budget. The document that crosses
the budget is taken in part (``cut_last``), so a source's words are its budget
exactly; without it, it is taken whole where that is nearer.

DataFrame functions only, and no source meets in one task: the logarithm of the
key cuts a source into cells, sums per cell show where its budget ends, and
only the rows of that one cell are ranked. Sources are numbered by range
partitions, budgets are integers.

Defined results: the uniform number comes from a hash of a seed, the id and the
text, so reruns agree. A null text has no words and takes nothing. Sources are
ordered by code point, null last; it is a source like another. A weight that
is null counts as 1, others are brought into ``LEAST_WEIGHT`` to
``MOST_WEIGHT`` (NaN: the least). Rows that repeat an id and a text tie; any of
them may come first, they are equal in what is returned. Long texts are
counted whole. Empty tables give empty results.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.plans.lookup import lookup_join

MOST_EPOCHS = 3
WEIGHTS = (1, 2, 3)
LEAST_WEIGHT, MOST_WEIGHT = 1e-6, 1e6
#: What separates words: blank and the controls 9 to 13 (fixed pattern).
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of the fullest cell of a source, about; sources of one range partition.
ROWS_PER_CELL = 2_000
SOURCES_PER_PART = 500_000
MOST_CELLS = 1 << 22
#: Logarithms of keys lie between these: u has 52 bits, weights are bounded.
LOWEST, HIGHEST = -52.0, 20.0
_WIDE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(key: Column, text: Column, seed: int = 0) -> Column:
    """A number between 0 and 1 from 52 bits of a hash."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")),
                               F.coalesce(F.md5(text), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def sampling_key(u: Column, weight: Column) -> Column:
    """Exponential with the weight as its rate; smaller keys come first."""
    bounded = F.when(F.isnan(weight), F.lit(LEAST_WEIGHT)).otherwise(
        F.greatest(F.least(F.coalesce(weight.cast("double"), F.lit(1.0)), F.lit(MOST_WEIGHT)), F.lit(LEAST_WEIGHT)))
    return -F.log(u) / bounded


def _numbered(sources: DataFrame, count: int) -> DataFrame:
    """``place`` (from 0) of every source by code point, null last, from range partitions."""
    order = F.col("source").asc_nulls_last()
    parts = -(-count // SOURCES_PER_PART)
    if parts <= 1:  # a known number of sources, not of rows
        return sources.withColumn("place", F.row_number().over(Window.orderBy(order)).cast("bigint") - 1)
    dealt = written(sources.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "mix-order")
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return (dealt.withColumn("inner", inner).join(F.broadcast(before.drop("n")), "part")  # one row per range partition
            .withColumn("place", (F.col("before") + F.col("inner") - 1).cast("bigint")).drop("part", "inner", "before"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, target, budget`` from ``source, source_size``, a stored table.

    A share is the words still to be dealt times the weight over all weights
    still open, both whole numbers. Each round closes the sources whose limit is
    below their share; only the two totals come to the driver.
    """
    seen = sizes.agg(F.count("*").alias("n"), F.sum("source_size").alias("total")).first()
    numbered = _numbered(sizes, seen["n"])
    by_place = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = written(numbered.withColumn("weight", by_place.cast("bigint")), "mix-sources")
    limit = MOST_EPOCHS * F.col("source_size")
    left, open_weights = int(seen["total"] or 0), None
    closed = F.lit(False)
    while True:
        totals = weighed.agg(
            F.sum(F.when(closed, limit).otherwise(0).cast(_WIDE)).alias("closed"),
            F.sum(F.when(~closed, F.col("weight")).otherwise(0).cast(_WIDE)).alias("weights")).first()
        now = (int(seen["total"] or 0) - int(totals["closed"] or 0), int(totals["weights"] or 0))
        if now == (left, open_weights) or now[1] == 0:
            break
        left, open_weights = now
        closed = limit.cast(_WIDE) * F.lit(Decimal(open_weights)) < F.col("weight").cast(_WIDE) * F.lit(Decimal(left))
    share = F.col("weight") * F.lit(left)
    divisor = max(open_weights or 1, 1)
    return weighed.select(
        "source", "source_size",
        F.when(closed, limit.cast("double")).otherwise(share.cast("double") / float(divisor)).alias("target"),
        F.when(closed, limit).otherwise(F.expr(f"(weight * {left}L) div {divisor}L")).alias("budget"))


def mix_sources(
    df: DataFrame, id_col: str, text_col: str, source_col: str, quality: DataFrame | None = None, *,
    weights: tuple[int, ...] = WEIGHTS, seed: int = 0, cut_last: bool = True,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """``id, size, source, source_size, target, taken``: words the mix takes of every row.

    ``quality`` has one row ``id, weight`` for each id with a quality weight;
    ids without one have the weight 1. ``weights`` are dealt to the sources in
    order, again and again. Texts are read once; only their sizes and hashes
    are joined and sorted.
    """
    text, key = F.col(text_col), F.col(id_col)
    rows = df.select(key.alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"),
                     uniform(key, text, seed).alias("u"), F.md5(text).alias("mark"))
    weight = F.lit(1.0)
    if quality is not None:
        weights_of = quality.select(F.col("id").alias("rated"), F.col("weight").alias("quality"))
        rows, weight = rows.join(weights_of, F.col("id") == F.col("rated"), "left"), F.col("quality")
    rows = written(rows.select("id", "source", "size", "mark", sampling_key(F.col("u"), weight).alias("key")), "mix-rows")
    counted = written(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sizes")
    fullest = counted.agg(F.max("n").alias("n"), F.count("*").alias("sources")).first()
    # equal weights put at most 0.37 of a source into one unit of the logarithm
    wanted = 0.37 * (HIGHEST - LOWEST) * (fullest["n"] or 0) / rows_per_cell
    cells = min(MOST_CELLS, 1 << max(0, math.ceil(math.log2(max(1.0, wanted)))))
    place = F.floor((F.log("key") - LOWEST) * (cells / (HIGHEST - LOWEST)))
    celled = rows.withColumns({
        "cell": F.greatest(F.lit(0), F.least(place, F.lit(cells - 1))).cast("bigint"),
        "name": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()})

    size = F.col("source_size")
    plan = source_targets(counted.drop("n"), weights).withColumns({
        "epochs": F.when(size > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("bigint"),
        "name": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()})
    plan = written(plan.withColumn("rest", F.col("budget") - F.col("epochs") * size).drop("source", "budget"), "mix-plan")
    sums = celled.groupBy("name", "none", "cell").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("name", "none").orderBy("cell"))
    reached = (sums.withColumn("upto", running)
               .join(plan.select("name", "none", "rest"), ["name", "none"])
               .filter((F.col("rest") > 0) & (F.col("upto") >= F.col("rest")))
               .groupBy("name", "none").agg(F.min(F.struct("cell", (F.col("upto") - F.col("words")).alias("below"))).alias("e"))
               .select("name", "none", F.col("e.cell").alias("edge"), F.col("e.below").alias("below")))
    # no budget left: the edge lies before all cells
    plan = written(plan.join(reached, ["name", "none"], "left").withColumn("edge", F.coalesce("edge", F.lit(-1))), "mix-edges")
    placed = lookup_join(celled, plan, ["name", "none"], spread_by=["key", "id"], at_most=fullest["sources"])

    whole = F.col("epochs") * F.col("size")
    out = ["id", "size", "source", "source_size", "target"]
    plain = placed.filter(F.col("cell") != F.col("edge")).select(
        *out, (whole + F.when(F.col("cell") < F.col("edge"), F.col("size")).otherwise(F.lit(0))).alias("taken"))
    before = F.col("below") + F.sum("size").over(
        Window.partitionBy("name", "none").orderBy("key", "id", "mark").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    room = F.col("rest") - before
    if cut_last:
        part = F.greatest(F.lit(0).cast("bigint"), F.least(room, F.col("size")))
    else:  # the whole document where more of it fits than not
        part = F.when((room > 0) & (2 * room >= F.col("size")), F.col("size")).otherwise(F.lit(0).cast("bigint"))
    edge = placed.filter(F.col("cell") == F.col("edge")).withColumn("part", part).select(
        *out, (whole + F.col("part")).alias("taken"))
    return plain.unionByName(edge)
