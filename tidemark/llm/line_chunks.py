"""Removal of repeated passages of several lines, cut where the content says.

A rolling hash runs over the hashes of ``WINDOW`` lines. Where it is smaller
than before and no greater than after, a chunk ends; chunk ends move with the
content, an inserted line only disturbs the chunks around it, and no chunk has
fewer than two lines unless its document has. A chunk that also stands earlier
in the corpus (smaller id, then text hash, then line) is a match. A match grows
line by line to both sides, as long as the next pair of lines stands earlier
too, so passages go up to their last line and not only to the ends of their
chunks. Passages are often shorter than the chunks they are cut into: a run of
``LEAST_RUN`` lines whose pairs all stand earlier goes without a matched chunk
in it; of runs of two lines only those that are a chunk go.

Chunks and pairs of lines meet by the MD5 hashes of their lines, a few bytes
for each; texts stay where they are. Then all lines of the corpus whose hash is
in a pair that stands earlier are compared by bytes: pairs with a hash that
stands for two different lines are no repeats.

DataFrame functions only. Spans are counted per task before they meet, and the
joins that find their occurrences can be split by Spark; they are merge joins at
every size, as all their sides grow with the corpus.

Defined results: a null text stays null and has no lines; an empty text is one
empty line. A text whose lines all go becomes empty. Rows that repeat an id and
its text are one document and lose the same lines; other texts under that id
are documents of their own. A null id is an id like another and comes first.
Texts of any length are cut whole. A line that goes is equal to one that stays.
Other columns stay as they are, whatever their names; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.llm.common import written

WINDOW = 2
#: Weight of the older line in the rolling hash, and its modulus (a prime).
FACTOR = 31
MODULUS = 65_521
#: Lines of a run that need no matched chunk.
LEAST_RUN = 3


def line_hash(mark: Column) -> Column:
    """Number from the first 32 bits of a line's MD5."""
    return F.conv(F.substring(mark, 1, 8), 16, 10).cast("bigint")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _indexes(first: int, last: Column) -> Column:
    """The numbers from ``first`` to ``last``; none if there are none."""
    return F.when(last >= first, F.sequence(F.lit(first), F.greatest(last, F.lit(first)))).otherwise(
        F.array().cast("array<int>"))


def chunked(df: DataFrame, text: Column) -> DataFrame:
    """Add ``marks``, the lines' hashes, and ``ends``, the last line of every chunk."""
    marked = df.withColumn("marks", F.transform(_lines(text), lambda line: F.md5(line))).withColumn("n", F.size("marks"))
    hashed = marked.withColumn("numbers", F.transform("marks", line_hash))
    rolled = hashed.withColumn("rolling", F.transform(_indexes(1, F.col("n") - 1), lambda i: F.pmod(
        FACTOR * F.element_at("numbers", i) + F.element_at("numbers", i + 1), F.lit(MODULUS))))
    least = F.filter(_indexes(2, F.col("n") - 2), lambda i: (
        F.element_at("rolling", i) < F.element_at("rolling", i - 1))
        & (F.element_at("rolling", i) <= F.element_at("rolling", i + 1)))
    return rolled.withColumn("ends", F.concat(least, F.array("n"))).drop("numbers", "rolling")


def _spans(chunks: DataFrame) -> DataFrame:
    """``id, text, first, last, chunk, h``: every chunk and every pair of lines.

    A pair is known by both its hashes, a chunk by the hash of all of its own.
    """
    starts = F.transform("ends", lambda e, k: F.when(k > 0, F.element_at("ends", F.greatest(k, F.lit(1))) + 1).otherwise(F.lit(1)))
    whole = F.transform(F.arrays_zip(starts.alias("first"), F.col("ends").alias("last")), lambda s: F.struct(
        s["first"].alias("first"), s["last"].alias("last"), F.lit(True).alias("chunk"),
        F.unhex(F.md5(F.array_join(F.slice("marks", s["first"], s["last"] - s["first"] + 1), ""))).alias("h")))
    pairs = F.transform(_indexes(1, F.col("n") - 1), lambda i: F.struct(
        i.alias("first"), (i + 1).alias("last"), F.lit(False).alias("chunk"),
        F.unhex(F.concat(F.element_at("marks", i), F.element_at("marks", i + 1))).alias("h")))
    return chunks.filter("n > 1").select("id", "text", F.inline(F.concat(whole, pairs)))


def _pair_marks(h: Column) -> Column:
    return F.array(F.substring(h, 1, 16), F.substring(h, 17, 16))


def _ambiguous(bodies: DataFrame, pairs: DataFrame) -> DataFrame:
    """``mark`` of the lines in ``pairs`` whose hash stands for different bytes in the corpus."""
    asked = written(pairs.select(F.explode(_pair_marks(F.col("h"))).alias("mark")).distinct(), "line-marks")
    lines = bodies.select(F.explode(_lines(F.col("body"))).alias("line")).withColumn("mark", F.unhex(F.md5("line")))
    same = lines.join(asked.hint("merge"), "mark", "left_semi").groupBy("mark").agg(F.min("line").alias("least"), F.max("line").alias("most"))
    return written(same.filter("least <> most").select("mark"), "line-ambiguous")


def repeated_runs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, runs`` of the documents that lose lines: arrays of (first, last), not touching.

    ``text`` is the text's hash.
    """
    keyed = df.select(col(id_col).alias("id"), F.md5(col(text_col)).alias("text"), col(text_col).alias("body")) \
        .filter(F.col("body").isNotNull())
    chunks = chunked(keyed, F.col("body")).drop("body")
    spans = written(_spans(chunks), "line-spans")
    # a null id is the least in a struct too
    place = F.struct("id", "text", "first")
    earliest = spans.groupBy("chunk", "h").agg(F.count("*").alias("times"), F.min(place).alias("home")) \
        .filter("times > 1").drop("times")
    home = F.col("id").eqNullSafe(F.col("home.id")) & (F.col("text") == F.col("home.text")) \
        & (F.col("first") == F.col("home.first"))
    later = written(spans.join(earliest.hint("merge"), ["chunk", "h"]).filter(~home)
                    .select("id", "text", "first", "last", "chunk", "h").distinct(), "line-later")
    different = _ambiguous(keyed, later.filter("NOT chunk"))
    if not different.isEmpty():  # pairs only, as a run is made of pairs
        for half in (0, 1):
            later = later.join(different, ~F.col("chunk") & (_pair_marks(F.col("h"))[half] == F.col("mark")), "left_anti")
    # the pairs of a matched chunk stand earlier as well; the chunk marks the run it starts in
    order = Window.partitionBy("id", "text").orderBy("first", "chunk")
    pair_end = F.when(~F.col("chunk"), F.col("last"))
    reached = F.max(pair_end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = later.withColumn("opens", (~F.col("chunk") & F.coalesce(F.col("first") > reached, F.lit(True))).cast("int"))
    runs = opened.withColumn("run", F.sum("opens").over(order)).groupBy("id", "text", "run").agg(
        F.min(F.when(~F.col("chunk"), F.col("first"))).alias("first"), F.max(pair_end).alias("last"),
        F.bool_or("chunk").alias("matched"))
    goes = F.col("matched") | (F.col("last") - F.col("first") + 1 >= LEAST_RUN)
    return runs.filter(goes & F.col("first").isNotNull()).groupBy("id", "text").agg(
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _with_runs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row``, all columns of a row in one, and its ``runs``."""
    gone = written(repeated_runs(df, id_col, text_col), "line-runs")
    rows = df.select(F.struct(*[col(c) for c in df.columns]).alias("row"))
    keyed = rows.select("row", F.col("row")[id_col].alias("rid"), F.md5(F.col("row")[text_col]).alias("mark"))
    return keyed.join(gone.hint("merge"), F.col("rid").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("text")), "left") \
        .select("row", "runs")


def _kept(body: Column) -> Column:
    def stays(line: Column, k: Column) -> Column:
        return ~F.exists("runs", lambda r: (k + 1 >= r["first"]) & (k + 1 <= r["last"]))

    return F.when(F.col("runs").isNull(), body).otherwise(F.array_join(F.filter(_lines(body), stays), "\n"))


def dedup_line_chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows with repeated passages taken out of the text."""
    body = F.col("row")[text_col]
    return _with_runs(df, id_col, text_col).select(
        *[(_kept(body) if c == text_col else F.col("row")[c]).alias(c) for c in df.columns])


def line_report(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n_lines, n_chunks, n_removed_runs, n_removed_lines, kept`` of every row."""
    found = _with_runs(df.select(col(id_col), col(text_col)), id_col, text_col) \
        .withColumn("body", F.col("row")[text_col])
    none = F.lit(0).cast("bigint")
    lost = F.aggregate("runs", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1).cast("bigint")
    given = F.col("body").isNotNull()
    return chunked(found, F.col("body")).select(
        F.col("row")[id_col].alias("id"),
        F.when(given, F.col("n").cast("bigint")).otherwise(none).alias("n_lines"),
        F.when(given, F.size("ends").cast("bigint")).otherwise(none).alias("n_chunks"),
        F.coalesce(F.size("runs").cast("bigint"), none).alias("n_removed_runs"),
        F.coalesce(lost, none).alias("n_removed_lines"), _kept(F.col("body")).alias("kept"))
