"""Words one edit apart, and the frequent word each rare one is a variant of.

The words form a trie, kept as a distributed table of edges (node, letter,
child); a node is the prefix it stands for. The search for neighbours moves a
frontier of states (word, position, node, edits) down the trie, one level per
join with the edges of that level. A state without an edit is the word's own
path. Where it leaves that path by a greater letter (replacement), or goes on
with the letter after the next (deletion), it becomes a state with one edit,
which may only follow the word's own letters from there on. A state at the end
of its word, on a node that is a word, is a neighbour. Every pair is found from
one side (the smaller letter, the longer word) and counts for both; of equal
letters in a row only the last is deleted, so no state arises twice.

Edges carry the count of the word their child is, and a signature of the
word ends below it: 64 bits, one set per hash of what is left to the end. A
state whose own rest is not among them is dropped, as no word can follow.

Levels are at most ``LONGEST`` letters. Longer words are compared by what is
left when one letter is taken out: rows (place, rest's hash), of which no group
has more members than there are letters; candidates are checked by bytes.

A word has many occurrences but is counted per task before it is shuffled.
Joins with few edges are broadcasts of a checked size, others are equi-joins
that Spark can split; a node has at most as many edges as there are letters.

Defined results: null and empty texts have no words. An id that is null is
written as an empty string where occurrences are altered. Rows that repeat an
id count again. Texts are read whole, words of any length are compared. Other
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import MIX_A, MIX_C, mix64, signed, written
from tidemark.llm.suffix_dedup import _powers as powers
from tidemark.plans.lookup import lookup_join

#: Letters of a word, and those that are made small (fixed sets).
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS = 6
LEAST_COUNT = 5
#: How many times as frequent a form must be.
FORM_FACTOR = 5
#: One occurrence in so many loses a letter.
ALTERED = 199
LONGEST = 64
#: Edges of a level that are broadcast: prefixes of at most LONGEST letters, about 100 bytes each.
BROADCAST_EDGES = 200_000


def _without(word: Column, at: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def word_counts(df: DataFrame, id_col: str, text_col: str, *, altered: int = ALTERED,
                least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough."""
    runs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                     F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    # a run only gets shorter
    long_enough = runs.filter(F.length("run") >= least_letters)
    ascii_only = F.length("run") == F.octet_length("run")
    small = long_enough.select("id", F.when(ascii_only, F.lower("run")).otherwise(
        F.translate("run", UPPER, LOWER)).alias("run"))
    hashed = small.withColumn("h", F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run"))))
    place = (F.col("h") % F.length("run")).cast("int")
    words = hashed.select(F.when(F.col("h") % altered == 0, _without(F.col("run"), place)).otherwise(
        F.col("run")).alias("word"))
    return (words.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= least_count))


def _letter(word: Column, at: Column) -> Column:
    """The letter at a place from 0; empty beyond the end."""
    return F.substring(word, at + 1, F.lit(1))


def _mark(rest: Column) -> Column:
    """Bit of what is left of a word."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(rest), F.lit(64)).cast("int"))


def trie_edges(words: DataFrame) -> DataFrame:
    """``depth, node, letter, child, below, word_n`` of the words' trie."""
    places = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("depth"))
    return places.groupBy(
        "depth", F.substring("word", F.lit(1), F.col("depth")).alias("node"), _letter(F.col("word"), F.col("depth")).alias("letter"),
    ).agg(
        F.bit_or(_mark(F.substring(F.col("word"), F.col("depth") + 2, F.length("word")))).alias("below"),
        F.max(F.when(F.length("word") == F.col("depth") + 1, F.col("n"))).alias("word_n"),
    ).withColumn("child", F.concat("node", "letter"))


def _near_in_trie(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``, every pair once; a stored table of words comes in."""
    edges = written(trie_edges(words), "spelling-edges")
    # one row per level
    levels = {r["depth"]: r["n"] for r in edges.groupBy("depth").agg(F.count("*").alias("n")).collect()}
    word, length = F.col("word"), F.length("word")
    state = ("word", "n", "position", "node", "node_n")
    found: list[DataFrame] = []
    frontier: DataFrame | None = None
    for depth in sorted(levels):
        at = F.lit(depth)
        step = edges.filter(F.col("depth") == depth).drop("depth")
        own = words.filter(length > depth).select("word", "n", F.substring(word, F.lit(1), at).alias("node"))
        here, after = _letter(word, at), _letter(word, at + 1)
        joined = lookup_join(own, step, ["node"], at_most=levels[depth], broadcast_rows=BROADCAST_EDGES)
        # a replacement, a deletion, or both by different paths
        replaced = (F.col("letter") > here) & _fits(word, at + 1)
        deleted = (after != "") & (after != here) & (F.col("letter") == after) & _fits(word, at + 2)
        left = joined.select(
            "word", "n", "child", "word_n",
            F.explode(F.filter(F.array(F.when(replaced, at + 1), F.when(deleted, at + 2)), lambda p: p.isNotNull())).alias("position"))
        moved = left.select("word", "n", "position", F.col("child").alias("node"), F.col("word_n").alias("node_n"))
        # the word without its last letter is its own path's node
        last = words.filter(length == depth + 2).select("word", "n", _letter(word, at).alias("letter"), F.substring(word, F.lit(1), at).alias("node"))
        shorter = lookup_join(last, step.filter("word_n IS NOT NULL"), ["node", "letter"], at_most=levels[depth],
                              broadcast_rows=BROADCAST_EDGES)
        moved = moved.unionByName(shorter.select(
            "word", "n", length.alias("position"), F.col("child").alias("node"), F.col("word_n").alias("node_n")))
        if frontier is not None:
            going = frontier.filter(F.col("position") < length).withColumn("letter", _letter(word, F.col("position")))
            went = lookup_join(going.drop("node_n"), step, ["node", "letter"], at_most=levels[depth],
                               broadcast_rows=BROADCAST_EDGES)
            moved = moved.unionByName(went.filter(_fits(word, F.col("position") + 1)).select(
                "word", "n", (F.col("position") + 1).alias("position"), F.col("child").alias("node"),
                F.col("word_n").alias("node_n")))
        frontier = written(moved.select(*state), "spelling-frontier")
        found.append(frontier.filter((F.col("position") == length) & F.col("node_n").isNotNull()).select(
            "word", "n", F.col("node").alias("near"), F.col("node_n").alias("near_n")))
    out = words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    for pairs in found:
        out = out.unionByName(pairs)
    return out


def _fits(word: Column, position: Column) -> Column:
    """Some word below the child ends like the word does from ``position`` on."""
    return F.col("below").bitwiseAND(_mark(F.substring(word, position + 1, F.length(word)))) != 0


def _holes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes of a long word, whole (place -1) and without each of its letters."""
    for batch in batches:
        for word, n in zip(batch["word"], batch["n"], strict=True):
            letters = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            size, both = len(letters), []
            with np.errstate(over="ignore"):
                for base in (MIX_A, MIX_C):
                    up, down = powers(base, size + 1)
                    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(letters * up[:size])]
                    rest = sums[:-1] + (sums[-1] - sums[1:]) * down[1]
                    both.append(signed(mix64(np.r_[sums[-1:], rest])))
            yield pd.DataFrame({"length": size, "whole": both[0][0], "also": both[1][0], "n": n,
                                "place": np.arange(-1, size), "h": both[0], "g": both[1]})


def _near_long(words: DataFrame) -> DataFrame:
    """The pairs among long words, every pair once."""
    holes = written(words.mapInPandas(
        _holes, "length int, whole long, also long, n long, place int, h long, g long"), "spelling-holes")
    one = holes.filter("place >= 0").select(*[F.col(c).alias(f"a_{c}") for c in holes.columns])
    replaced = one.join(holes, (F.col("a_place") == F.col("place")) & (F.col("a_h") == F.col("h")) & (F.col("a_g") == F.col("g"))
                        & (F.col("a_length") == F.col("length"))
                        & (F.struct("a_whole", "a_also") < F.struct("whole", "also")))
    shorter = one.join(holes.filter("place = -1"), (F.col("a_length") - 1 == F.col("length")) & (F.col("a_h") == F.col("h"))
                       & (F.col("a_g") == F.col("g")))
    # a word is known by its length and two hashes; the pairs found are compared as text
    names = ("length", "whole", "also")
    pairs = replaced.unionByName(shorter).select(*[F.col(f"a_{c}") for c in names], *names).distinct()
    spelled = written(holes.filter("place = -1").select(*names).join(
        words.mapInPandas(_named, "length int, whole long, also long, word string, n long"), list(names)), "spelling-long")
    near = spelled.select(*names, F.col("word").alias("near"), F.col("n").alias("near_n"))
    mine = spelled.select(*[F.col(c).alias(f"a_{c}") for c in names], "word", "n")
    return (pairs.join(mine, [f"a_{c}" for c in names]).join(near, list(names))
            .filter(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n"))


def _named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        heads = [next(iter(_holes([batch.iloc[i : i + 1]]))).iloc[0] for i in range(len(batch))]
        yield pd.DataFrame({"length": [h["length"] for h in heads], "whole": [h["whole"] for h in heads],
                            "also": [h["also"] for h in heads], "word": batch["word"], "n": batch["n"]})


def near_words(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``word, n, near, near_n`` of all pairs one edit apart, from both sides.

    ``words`` is a stored table ``word, n`` without repeats.
    """
    pairs = _near_in_trie(words.filter(F.length("word") <= longest))
    long = words.filter(F.length("word") >= longest)
    if not long.filter(F.length("word") > longest).isEmpty():
        # pairs of two words of the trie are found there
        pairs = pairs.unionByName(_near_long(long).filter(F.greatest(F.length("word"), F.length("near")) > longest))
    return pairs.unionByName(pairs.select(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def variant_forms(words: DataFrame, factor: int = FORM_FACTOR, longest: int = LONGEST) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a stored table ``word, n``."""
    nearest = near_words(words, longest).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    taken = -F.col("best.less") >= factor * F.col("n")
    formed = written(
        words.join(nearest, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")),
        "spelling-forms")
    # counts grow by the factor along a chain, so a few doublings reach its end
    roots = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        above = roots.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        moved = written(roots.join(above, "root", "left"), "spelling-roots")
        roots = moved.select("word", F.coalesce("higher", "root").alias("root"))
        if moved.filter("higher IS NOT NULL").isEmpty():
            break
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """Forms and roots of the words of whole texts; ``options`` are those of ``word_counts``."""
    return variant_forms(written(word_counts(df, id_col, text_col, **options), "spelling-words"))
