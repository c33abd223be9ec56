"""Byte-level byte-pair encoding and decoding by ranked merges.

A word is an array of bytes; the adjacent pair whose joined bytes have the
lowest rank is merged, the leftmost of equals, until no pair has a rank. A
word that has a rank itself is one id. Decoding concatenates the bytes of the
ids.

``encode_words`` is that as Spark higher-order functions: a fold over the
bytes of distinct words, with the ranks as a literal map that is cut into
buckets, since Spark searches a map from its start. It encodes the frequent
words of a bounded sample of texts, which are handed to every task. Words that
are not among them are merged in the tasks, many distinct words at once, by
the same rule (see the README for the figures that led to this). Which words
are frequent decides speed only.

Texts are cut into runs of one optional space and what follows up to the next
white space; the pattern cannot match across their ends, so a task remembers
the ids of runs and splits each run once.

Defined results: a null text is empty and has no ids. Special tokens in a text
are ordinary text. Repeated rows are encoded each for itself; other columns
are ignored; empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe_merges import PairTable, merge_words
from tidemark.llm.common import arrow_pieces, replaced, written

MAP_BUCKETS = 16_384
#: Bounds of the words that are encoded ahead, and of the texts they come from.
FREQUENT_WORDS = 65_536
SAMPLE_TEXTS = 2_000
#: Longer words are left to the tasks: the fold takes a step for each byte.
LONGEST_FOLDED = 32
REMEMBERED_RUNS = 400_000
_RUN = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Characters that Python takes for space and the pattern does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_NO_RANK = 1 << 30


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _pattern(pattern: str) -> regex.Pattern:
    # the library's \s is the White_Space property
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank of each token, keyed by its bytes in hex, as an array of small maps."""
    buckets: list[dict[str, int]] = [{} for _ in range(MAP_BUCKETS)]
    for token, rank in ranks.items():
        key = token.hex().upper()
        buckets[zlib.crc32(key.encode()) % MAP_BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def _rank(buckets: Column, key: Column) -> Column:
    bucket = F.element_at(buckets, (F.crc32(key.cast("binary")) % MAP_BUCKETS).cast("int") + 1)
    return F.coalesce(F.try_element_at(bucket, key), F.lit(_NO_RANK))


def _folded(buckets: Column, word: Column) -> Column:
    """Ids of a word given as hex: a fold that merges one pair in each step."""
    size = (F.length(word) / 2).cast("int")
    single = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(word, 2 * i - 1, 2))

    def pair_ranks(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                           lambda i: _rank(buckets, F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))))

    none = F.array().cast("array<int>")
    start = F.struct(single.alias("p"), F.when(size > 1, pair_ranks(single)).otherwise(none).alias("r"))

    def step(acc: Column, _: Column) -> Column:
        p, r = acc["p"], acc["r"]
        least = F.array_min(r)

        def merged(i: Column) -> Column:
            joined = F.concat(F.element_at(p, i), F.element_at(p, i + 1))
            left = F.when(i > 1, F.array(_rank(buckets, F.concat(F.element_at(p, F.greatest(i - 1, F.lit(1))), joined))))
            right = F.when(i + 2 <= F.size(p),
                           F.array(_rank(buckets, F.concat(joined, F.element_at(p, F.least(i + 2, F.size(p)))))))
            return F.struct(
                F.concat(F.slice(p, F.lit(1), i - 1), F.array(joined), F.slice(p, i + 2, F.size(p))).alias("p"),
                F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), F.coalesce(left, none),
                         F.coalesce(right, none), F.slice(r, i + 2, F.size(p))).alias("r"))

        place = F.array(F.array_position(r, least).cast("int"))
        return F.when(F.coalesce(least, F.lit(_NO_RANK)) < _NO_RANK,
                      F.element_at(F.transform(place, merged), 1)).otherwise(acc)

    folded = F.aggregate(F.sequence(F.lit(1), size), start, step, lambda acc: acc["p"])
    whole = _rank(buckets, word)
    return F.when(whole < _NO_RANK, F.array(whole)).otherwise(
        F.transform(folded, lambda piece: _rank(buckets, piece)))


def encode_words(words: DataFrame, word_col: str, ranks: dict[bytes, int]) -> DataFrame:
    """The rows with ``ids``: each word's ids, by higher-order functions alone."""
    hexed = F.hex(F.encode(F.coalesce(F.col(word_col), F.lit("")), "utf-8"))
    # one-element arrays bind the literal and the word once
    return words.withColumn("ids", F.when(F.length(hexed) > 0, F.element_at(F.transform(
        F.array(rank_literal(ranks)),
        lambda buckets: F.element_at(F.transform(F.array(hexed), lambda w: _folded(buckets, w)), 1)), 1))
        .otherwise(F.array().cast("array<int>")))


def frequent_words(texts: DataFrame, pattern: str, ranks: dict[bytes, int]) -> dict[str, list[int]]:
    """Ids of the most frequent words of a bounded sample of texts."""
    total = texts.count()
    if not total:
        return {}
    draw = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = texts.withColumn("draw", draw).filter(F.col("draw") < 1.2 * SAMPLE_TEXTS / total) \
        .orderBy("draw").limit(SAMPLE_TEXTS)
    words = (sample.repartition(32).select(F.explode(F.regexp_extract_all("text", F.lit("(?U)" + pattern), F.lit(0))).alias("word"))
             .groupBy("word").agg(F.count("*").alias("n"))
             .filter(F.octet_length("word") <= LONGEST_FOLDED)
             .orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS))
    found = encode_words(written(words, "bpe-words").repartition(32), "word", ranks)
    return {r["word"]: r["ids"] for r in found.select("word", "ids").collect()}  # FREQUENT_WORDS at most


class ByteTokenizer:
    """Ids of texts, run by run; equal runs are split and merged once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, frequent: dict[str, list[int]]):
        self.ranks, self.pattern = ranks, _pattern(pattern)
        self.frequent_ids = {word: np.array(ids, "<u4").tobytes() for word, ids in frequent.items()}
        size = max(ranks.values(), default=0) + 1
        self.pieces = [b""] * size
        for token, rank in ranks.items():
            self.pieces[rank] = token
        splits = [(ranks[token[:i]], ranks[token[i:]], rank) for token, rank in ranks.items()
                  for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        first, second, merged = (np.array(c, np.int64) for c in zip(*splits, strict=True)) if splits else [[]] * 3
        self.table = PairTable(first, second, merged, merged, size)
        self.single = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int64)
        self.decimal = [str(i) for i in range(size)]
        self.known: dict[str, bytes] = {}

    def learn(self, runs: list[str]) -> None:
        """Remember the ids of runs that are not known yet."""
        owners: list[int] = []
        whole: list[bytes | None] = []  # ids that need no merge
        words: list[bytes] = []
        known_word = self.frequent_ids.get
        rank_of = self.ranks.get
        for k, run in enumerate(runs):
            # a space and letters are one word of the pattern
            for word in (run,) if run.isalpha() or run[:1] == " " and run[1:].isalpha() else self.pattern.findall(run):
                owners.append(k)
                ids = known_word(word)
                if ids is None:
                    raw = word.encode()
                    rank = rank_of(raw)
                    if rank is None:
                        words.append(raw)
                    else:
                        ids = rank.to_bytes(4, "little")
                whole.append(ids)
        if words:
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            ids, sizes = merge_words(self.single[np.frombuffer(b"".join(words), np.uint8)], lengths, self.table)
            to = np.cumsum(4 * sizes).tolist()
            flat = ids.astype("<u4").tobytes()
            merged = iter([flat[i:j] for i, j in zip([0, *to], to, strict=False)])
            whole = [next(merged) if w is None else w for w in whole]
        joined: dict[int, bytes] = {}
        for k, ids in zip(owners, whole, strict=True):
            joined[k] = joined[k] + ids if k in joined else ids
        self.known.update((run, joined.get(k, b"")) for k, run in enumerate(runs))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED_RUNS:
            self.known.clear()
        split = [[t] if _NOT_SPACE.search(t) else _RUN.findall(t) for t in texts]
        new = {r for runs in split for r in runs}.difference(self.known)
        self.learn(sorted(new))
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, runs)), "<u4") for runs in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def encode_texts(df: DataFrame, id_col: str, text_col: str, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``id, n_tokens, ids, decoded`` of every row; ``ids`` is little-endian 32-bit."""
    return _tokenized(df, id_col, text_col, ranks, pattern, digests=False)


def encode_digests(df: DataFrame, id_col: str, text_col: str, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of every row."""
    return _tokenized(df, id_col, text_col, ranks, pattern, digests=True)


def _tokenized(df, id_col, text_col, ranks, pattern, *, digests: bool) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    context = df.sparkSession.sparkContext
    shared = context.broadcast((ranks, pattern, frequent_words(rows.select("text"), pattern, ranks)))
    schema = rows.drop("text").schema.add("n_tokens", "long")
    schema = schema.add("ids_sha256", "string").add("decoded_sha256", "string") if digests else \
        schema.add("ids", "binary").add("decoded", "binary")

    def run(batches):
        tokenizer = ByteTokenizer(*shared.value)
        for batch in arrow_pieces(batches, 1024):
            ids = tokenizer.encode(batch.column("text").to_pylist())
            new = {"n_tokens": pa.array([len(i) for i in ids], pa.int64())}
            if digests:
                decimal = tokenizer.decimal.__getitem__
                new["ids_sha256"] = pa.array(
                    [hashlib.sha256(",".join(map(decimal, i.tolist())).encode()).hexdigest() for i in ids], pa.string())
                new["decoded_sha256"] = pa.array(
                    [hashlib.sha256(tokenizer.decode(i)).hexdigest() for i in ids], pa.string())
            else:
                new["ids"] = pa.array([i.tobytes() for i in ids], pa.binary())
                new["decoded"] = pa.array([tokenizer.decode(i) for i in ids], pa.binary())
            yield replaced(batch, "text", **new)

    return rows.mapInArrow(run, schema)
