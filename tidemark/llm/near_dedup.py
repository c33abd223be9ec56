"""Near copies by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words. A shingle weighs its count in the text times
the mean inverse document frequency of its words; document frequencies are
counted over all documents, in a table of 65,536 hashed words whose size does
not grow. Each text gets 72 weighted samples; 18 bands of four samples group
texts, and a pair is linked when the weighted Jaccard similarity of its
shingles, computed from the whole texts, is 0.8 or more. A pair of that
similarity shares no band with probability (1 - 0.8^4)^18 < 1e-4.

Texts with the same words in the same order are one class from the start and
stand in for each other. Inside a band the samples of all members are compared
in tasks, in blocks that meet in pairs, so a large group is spread and no pair
leaves a task without need. Pairs are then computed in three rounds: for each
member the most similar one before it in its band; for each member the most
similar one it is not connected with; and then every pair whose ends are not
connected by that, whatever their number; these are compared where blocks of
members meet with their texts, and are never rows. Pairs whose
samples agree in fewer than 46 of 72 places are not computed: at a similarity
of 0.8 that happens with probability below 1e-3, and only matters where no
other link connects the two.

Defined results: a text of one to four words is a single shingle; null texts
and texts without words link with nothing. Rows that share an id are one
document, with the smallest class of its texts. Rows with a null id take part in nothing and are kept. Other columns
are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.llm.common import MIX_A, freed, meet_in_blocks, mix64, pairs_in_runs, pieces, signed, written
from tidemark.llm.components import connected_components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 18
ROWS = 4
SAMPLES = BANDS * ROWS
#: Samples that must agree before a pair is computed exactly.
LEAST_AGREEING = 46
BLOCK_ROWS = 1024
SHARD_ROWS = 20_000
#: Rows of a block whose texts are compared in one task.
TEXT_ROWS = 256
WORD_BUCKETS = 1 << 16
#: Long words a task remembers the hash of (about 20 MB); beyond it the memory starts anew.
REMEMBERED_WORDS = 1 << 17
#: Shingles of texts a task remembers while it compares them (about 12 MB).
REMEMBERED_SHINGLES = 1 << 20
#: Pairs whose texts a task reads at a time.
PAIRS_READ = 32
#: Pairs whose samples a task compares at a time (about 10 MB).
PAIRS_AT_ONCE = 1 << 14
#: Characters whose words a task finds at a time (about 8 MB); a longer text is taken whole.
CHARS_AT_ONCE = 1 << 18
_WORD = re.compile(r"\w+")
#: Shingles whose samples are drawn at a time: what a step holds stays in a core's cache.
_STEP = 512
#: Constants of xxh64, and the length from which it works in stripes.
_PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63,
                                  0x27D4EB2F165667C5)]
_STRIPE = 32


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def forget_words() -> None:
    _HASHES.clear()


@functools.cache
def _in_word() -> np.ndarray:
    """For each code point, whether it belongs to words."""
    every = np.arange(sys.maxunicode + 1, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    table = np.zeros(len(every), bool)
    for run in _WORD.finditer(every):
        table[run.start() : run.end()] = True
    return table


def _hashed(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxh64 of the words of ``data`` that begin at ``start`` and have ``size`` bytes."""
    p1, p2, p3, p4, p5 = _PRIMES
    padded = data + bytes(8)
    eights, fours, ones = (np.ndarray(len(data) + 1, kind, padded, strides=(1,)) for kind in ("<u8", "<u4", "u1"))

    def turned(x: np.ndarray, bits: int) -> np.ndarray:
        return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))

    h = size.astype(np.uint64) + p5
    for done in range(0, min(int(size.max(initial=0)), _STRIPE) - 7, 8):
        at = (size >= done + 8).nonzero()[0]
        h[at] = turned(h[at] ^ (turned(eights[start[at] + done] * p2, 31) * p1), 27) * p1 + p4
    at = (size & 4).nonzero()[0]
    h[at] = turned(h[at] ^ (fours[start[at] + (size[at] & ~7)] * p1), 23) * p2 + p3
    for done in range(3):
        at = ((size & 3) > done).nonzero()[0]
        h[at] = turned(h[at] ^ (ones[start[at] + (size[at] & ~3) + done] * p5), 11) * p1
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    h ^= h >> np.uint64(32)
    for k in (size >= _STRIPE).nonzero()[0].tolist():
        h[k] = _HASHES[data[start[k] : start[k] + size[k]]]
    return h


def _codes_of(lowered: list[str]) -> list[np.ndarray]:
    ends = np.cumsum([len(text) + 1 for text in lowered])
    # line breaks before, between and after the texts, so that every word has a beginning and an end
    chars = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "replace"), "<u4")
    inside = _in_word().take(chars, mode="clip")
    edges = (inside[1:] != inside[:-1]).nonzero()[0]
    first, last = edges[::2], edges[1::2]
    kept = chars[inside]
    data = kept.tobytes().decode("utf-32-le").encode()
    stop = (last - first).cumsum()
    if len(data) > len(kept):
        width = np.ones(len(kept), np.int8)
        for wider in (0x80, 0x800, 0x10000):
            width += kept >= wider
        stop = width.cumsum(dtype=np.int64)[stop - 1]
    start = np.r_[0, stop[:-1]]
    codes, cuts = _hashed(data, start, stop - start), first.searchsorted(ends).tolist()
    return [codes[a:b] for a, b in pairwise([0, *cuts])]


def codes_of_texts(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """``word_codes`` of each text, found for many texts at a time."""
    held, chars = [], 0
    for text in texts:
        held.append(text.lower() if text else "")
        chars += len(held[-1])
        if chars >= CHARS_AT_ONCE:
            yield from _codes_of(held)
            held, chars = [], 0
    if held:
        yield from _codes_of(held)


def word_codes(text: str | None) -> np.ndarray:
    """64-bit hash of each word of the lower-cased text."""
    return next(codes_of_texts([text]))


def _bucket(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(48)).astype(np.int64)


def _count_words(batches):
    counts = np.zeros(WORD_BUCKETS + 1, dtype=np.int64)
    for batch in pieces(batches):
        for codes in codes_of_texts(batch["text"]):
            counts[np.unique(_bucket(codes))] += 1
            counts[WORD_BUCKETS] += 1
    seen = np.flatnonzero(counts)
    yield pd.DataFrame({"bucket": seen, "n": counts[seen]})


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """1 + ln((1 + documents) / (1 + documents with the word)) per word bucket."""
    rows = texts.select("text").mapInPandas(freed(_count_words, forget_words), "bucket long, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # 65,537 rows at most
    counts = np.zeros(WORD_BUCKETS + 1)
    for row in rows:
        counts[row["bucket"]] = row["n"]
    return (1 + np.log((1 + counts[-1]) / (1 + counts[:-1]))).astype(np.float32)


def shingle_weights(codes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and their weights (float32)."""
    if not len(codes):
        return np.empty(0, np.uint64), np.empty(0, np.float32)
    width = min(SHINGLE_WORDS, len(codes))
    n = len(codes) - width + 1
    words = idf[_bucket(codes)]
    hashes = np.zeros(n, np.uint64)
    share = np.zeros(n, np.float32)
    with np.errstate(over="ignore"):
        for i in range(width):
            hashes = (hashes ^ codes[i : i + n]) * np.uint64(MIX_A)
            hashes ^= hashes >> np.uint64(32)
            share += words[i : i + n]
    order = hashes.argsort()
    hashes = hashes[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    times = np.diff(first, append=n)
    return hashes[first], (share[order[first]] / np.float32(width)) * times.astype(np.float32)


@dataclass(frozen=True)
class _Draws:
    """Fixed random tables of the sampling: quantiles of Gamma(2, 1), odd multipliers."""

    gamma: np.ndarray
    log_gamma: np.ndarray
    odd: np.ndarray


def _draws() -> _Draws:
    # quantiles of Gamma(2, 1) by damped Newton steps on 1 - (1 + x) exp(-x)
    share = (np.arange(1024) + 0.5) / 1024
    x = np.full(1024, 1.5)
    for _ in range(200):
        x = np.clip(x - (1 - (1 + x) * np.exp(-x) - share) / np.maximum(x * np.exp(-x), 1e-12) * 0.5, 1e-4, 40)
    odd = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(MIX_A)) >> np.uint64(32)
    return _Draws(x.astype(np.float32), np.log(x).astype(np.float32), odd.astype(np.uint32)[:, None] | np.uint32(1))


_DRAWS = _draws()


def weighted_samples(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One 64-bit value per hash function; equal with the probability of the weighted Jaccard similarity."""
    log_weight = np.log(weights.astype(np.float64)).astype(np.float32)
    best = np.full(SAMPLES, np.inf, np.float32)
    drawn = np.zeros(SAMPLES, np.uint64)
    row = np.arange(SAMPLES)
    for start in range(0, len(shingles), _STEP):
        part = shingles[start : start + _STEP]
        # 32 fresh bits per hash function and shingle: 10 choose r, 10 choose c, 12 are beta
        z = _DRAWS.odd * (part >> np.uint64(32)).astype(np.uint32)
        z ^= z >> np.uint32(15)
        z *= np.uint32(0x2C1B3C6D)
        z ^= z >> np.uint32(12)
        r = _DRAWS.gamma.take((z >> np.uint32(22)).astype(np.intp), mode="clip")
        log_c = _DRAWS.log_gamma.take(((z >> np.uint32(12)) & np.uint32(1023)).astype(np.intp), mode="clip")
        z &= np.uint32(4095)
        beta = z.astype(np.float32)
        beta *= np.float32(2**-12)
        t = log_weight[start : start + _STEP] / r
        t += beta
        np.floor(t, out=t)
        # ln a = ln c - r (t - beta) - r
        rank = np.subtract(beta, t, out=beta)
        rank -= np.float32(1)
        rank *= r
        rank += log_c
        at = rank.argmin(axis=1)
        value = rank[row, at]
        better = value < best
        best[better] = value[better]
        with np.errstate(over="ignore"):
            key = mix64(part[at] ^ (t[row, at].astype(np.int64).view(np.uint64) * np.uint64(MIX_A)))
        drawn[better] = key[better]
    return drawn


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A key for each band of the samples of a text, or of many texts."""
    parts = samples.reshape(*samples.shape[:-1], BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            key = mix64((key * np.uint64(MIX_A)) ^ parts[..., i])
    return key


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    x, y = a[1][at_a].astype(np.float64), b[1][at_b].astype(np.float64)
    both = np.minimum(x, y).sum()
    whole = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - both
    return both / whole if whole else 0.0


def _signatures(texts: DataFrame, idf) -> DataFrame:
    """``id, class_key, samples, bands``; nulls for texts without words."""

    def run(batches):
        weights = idf.value
        for batch in pieces(batches):
            keys, drawn = [], []
            for codes in codes_of_texts(batch["text"]):
                keys.append(xxhash.xxh3_128_digest(codes.tobytes()) if len(codes) else None)
                if len(codes):
                    drawn.append(weighted_samples(*shingle_weights(codes, weights)))
            drawn = np.array(drawn, np.uint64).reshape(-1, SAMPLES)
            of_words = iter((drawn & np.uint64(0x7FFFFFFF)).astype(np.int32)), iter(signed(band_keys(drawn)))
            samples, bands = ([next(rows) if key else None for key in keys] for rows in of_words)
            yield pd.DataFrame({"id": batch["id"], "class_key": keys, "samples": samples, "bands": bands})

    return texts.mapInPandas(freed(run, forget_words), "id long, class_key binary, samples array<int>, bands array<long>")


def _ends(rows: pd.DataFrame, side: np.ndarray, group: np.ndarray):
    """Pairs of rows of a group whose samples agree often enough and whose components differ.

    Yields places in ``rows``, how many samples agree, and whether the rows' band is
    the first that the two share: that one speaks for the pair. ``rows`` are in the
    order of ``group``.
    """
    ids, at = np.unique(rows["id"].to_numpy(), return_inverse=True)
    first = np.zeros(len(ids), np.int64)
    first[at[::-1]] = np.arange(len(rows))[::-1]
    samples = np.array(rows["samples"].iloc[first].tolist(), np.int32).reshape(-1, SAMPLES)
    component = rows["component"].to_numpy()[first]
    band = rows["band"].to_numpy()
    for p, q in pairs_in_runs(group, side, PAIRS_AT_ONCE):
        apart = component[at[p]] != component[at[q]]
        p, q = p[apart], q[apart]
        equal = samples[at[p]] == samples[at[q]]
        agree = equal.sum(axis=1)
        enough = agree >= LEAST_AGREEING
        p, q, equal, agree = p[enough], q[enough], equal[enough], agree[enough]
        yield p, q, agree, equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band[p]


def _meetings(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows by meeting, the side of each (negative where all pairs count) and its meeting."""
    rows = rows.sort_values(["key", "one", "two", "id"])
    group = rows.groupby(["key", "one", "two"], sort=False).ngroup().to_numpy()
    return rows, np.where(rows["one"] != rows["two"], rows["mine"], -1), group


def _proposed(rows: pd.DataFrame, how: str) -> pd.DataFrame:
    """Pairs of a shard, for each member the best of those before it (``earlier``) or of all (``best``)."""
    rows, side, group = _meetings(rows)
    ids = rows["id"].to_numpy()
    out = [_best(pd.DataFrame({"x": ids[p], "y": ids[q], "agree": agree}), how)
           for p, q, agree, _ in _ends(rows, side, group)]
    found = _best(pd.concat(out), how) if out else pd.DataFrame(columns=["x", "y"], dtype="int64")
    return found[["x", "y"]].drop_duplicates()


def _with_partners(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows that are an end of any pair of a shard."""
    rows, side, group = _meetings(rows)
    ends = np.zeros(len(rows), bool)
    for p, q, _, speaks in _ends(rows, side, group):
        ends[p[speaks]] = ends[q[speaks]] = True
    return rows[ends]


def _joined_in(rows: pd.DataFrame, weights: np.ndarray, similarity: float) -> pd.DataFrame:
    """Links of a shard whose rows bring their texts; pairs that its links connect already need no test."""
    try:
        rows = rows.sort_values(["key", "half", "other_half", "one", "two", "id"])
        group = rows.groupby(["key", "half", "other_half", "one", "two"], sort=False).ngroup().to_numpy()
        across = np.where(rows["one"] != rows["two"], rows["mine"], -1)
        halves = np.where(rows["half"] != rows["other_half"], rows["side"], -1)
        ids, texts, component = rows["id"].to_numpy(), rows["text"].to_numpy(), rows["component"].to_numpy()
        up: dict[int, int] = {}
        remembered: dict[str, tuple] = {}
        held, out = 0, []

        def root(x: int) -> int:
            while (above := up.get(x, x)) != x:
                up[x] = up.get(above, above)
                x = above
            return x

        def vector(text: str):
            nonlocal held
            if text not in remembered:
                if held >= REMEMBERED_SHINGLES:
                    remembered.clear()
                    held = 0
                remembered[text] = shingle_weights(word_codes(text), weights)
                held += len(remembered[text][0])
            return remembered[text]

        for p, q, _, speaks in _ends(rows, across, group):
            speaks &= (halves[p] < 0) | (halves[p] != halves[q])
            for i, j in zip(p[speaks].tolist(), q[speaks].tolist(), strict=True):
                a, b = root(component[i]), root(component[j])
                if a != b and weighted_jaccard(vector(texts[i]), vector(texts[j])) >= similarity - 1e-9:
                    up[a] = b
                    out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    finally:
        forget_words()


def _best(found: pd.DataFrame, how: str) -> pd.DataFrame:
    ranked = found.sort_values(["agree", "x", "y"], ascending=[False, True, True])
    if how == "earlier":
        return ranked.drop_duplicates(["y"])
    return pd.concat([ranked.drop_duplicates(["x"]), ranked.drop_duplicates(["y"])])


def _placed(met: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows with their ``component``, of keys that hold more than one."""
    placed = met.join(rooted, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .filter("lo < hi").select("key")
    return placed.join(mixed, "key", "left_semi")


def _shard(met: DataFrame) -> Column:
    shards = F.lit(max(1, -(-met.count() // SHARD_ROWS)))
    return F.pmod(F.xxhash64("key", "one", "two"), shards).alias("shard")


def _propose(met: DataFrame, rooted: DataFrame | None, how: str) -> DataFrame:
    """Distinct pairs ``x`` < ``y`` out of all bands, of members that are not connected yet."""
    placed = met.withColumn("component", F.col("id")) if rooted is None else _placed(met, rooted)
    return placed.groupBy(_shard(met)).applyInPandas(
        lambda rows: _proposed(rows, how), "x long, y long").distinct()


def _remaining_links(met: DataFrame, rooted: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """Links among all pairs whose ends are not connected, whatever their number.

    Such pairs are never rows: the members that have any partner meet again in
    blocks, with their texts, and are compared in the tasks.
    """
    placed = _placed(met, rooted).select("key", "band", "id", "mine", "one", "two", "samples", "component")
    schema = placed.schema
    ends = written(placed.groupBy(_shard(met)).applyInPandas(_with_partners, schema), "near-ends") \
        .withColumnsRenamed({"mine": "side", "one": "half", "two": "other_half"})
    meeting = ["key", "half", "other_half"]
    sizes = ends.groupBy(*meeting).agg(F.count("*").alias("n"))
    rows = sizes.agg(F.sum(F.col("n") * F.ceil(F.col("n") / TEXT_ROWS))).first()[0] or 0
    blocks = meet_in_blocks(ends.join(sizes, meeting), "n", "id", TEXT_ROWS)
    shard = F.pmod(F.xxhash64(*meeting, "one", "two"), F.lit(max(1, -(-rows // (4 * TEXT_ROWS)))))
    return written(
        blocks.join(texts, "id").groupBy(shard.alias("shard")).applyInPandas(
            lambda held: _joined_in(held, idf.value, similarity), "a long, b long"), "near-links")


def _linked(pairs: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """The pairs whose weighted Jaccard similarity is at least ``similarity``, as ``a, b``."""
    first = texts.select(F.col("id").alias("x"), F.col("text").alias("tx"))
    second = texts.select(F.col("id").alias("y"), F.col("text").alias("ty"))

    def run(batches):
        weights = idf.value
        remembered: dict[int, tuple] = {}
        held = 0

        for batch in pieces(batches, PAIRS_READ):
            if held >= REMEMBERED_SHINGLES:
                remembered.clear()
                held = 0
            unread: dict[int, str] = {}
            for x, y, tx, ty in zip(batch["x"], batch["y"], batch["tx"], batch["ty"], strict=True):
                for key, text in ((x, tx), (y, ty)):
                    if key not in remembered:
                        unread.setdefault(key, text)
            for key, codes in zip(unread, codes_of_texts(unread.values()), strict=True):
                remembered[key] = shingle_weights(codes, weights)
                held += len(remembered[key][0])
            near = [weighted_jaccard(remembered[x], remembered[y]) >= similarity - 1e-9
                    for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield pd.DataFrame({"a": batch["x"][near], "b": batch["y"][near]})

    return written(pairs.join(second, "y").join(first, "x").select("x", "y", "tx", "ty")
                   .mapInPandas(freed(run, forget_words), "a long, b long"), "near-links")


def near_classes(df: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """``id, class_id, kept``: one row per non-null id; the smallest id of a class is kept.

    An id that several rows share gets the smallest class of its texts.
    """
    spark = df.sparkSession
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    idf = spark.sparkContext.broadcast(inverse_frequencies(texts))
    signed_rows = written(_signatures(texts, idf), "near-samples")
    exact = written(
        signed_rows.filter("class_key is not null").groupBy("class_key").agg(F.min("id").alias("rep")),
        "near-exact")
    members = signed_rows.select("id", "class_key").join(exact, "class_key", "left") \
        .select("id", F.coalesce("rep", "id").alias("rep"))
    drawn = written(
        signed_rows.join(exact, "class_key").filter("id = rep").dropDuplicates(["id", "class_key"])
        .select("id", "samples", "bands"), "near-drawn")
    banded = drawn.select("id", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = meet_in_blocks(banded.join(shared, "key"), "n", "id", BLOCK_ROWS).select(
        "key", "band", "id", "mine", "one", "two")
    met = written(met.join(drawn.select("id", "samples"), "id"), "near-met")
    # a text that repeats under its id is needed once
    bound = written(texts.join(met.select("id").distinct(), "id", "left_semi").groupBy("id").agg(
        F.collect_set("text").alias("texts")).select("id", F.explode("texts").alias("text")), "near-texts")

    tested = written(_propose(met, None, "earlier"), "near-pairs")
    links = _linked(tested, bound, idf, similarity)
    pairs = written(_propose(met, connected_components(links), "best").join(tested, ["x", "y"], "left_anti"),
                    "near-pairs")
    links = links.unionByName(_linked(pairs, bound, idf, similarity))
    links = links.unionByName(_remaining_links(met, connected_components(links), bound, idf, similarity))
    rooted = connected_components(links)
    root = rooted.select(F.col("id").alias("rep"), "component")
    return (members.join(root, "rep", "left").groupBy("id")
            .agg(F.min(F.coalesce("component", "rep")).alias("class_id"))
            .select("id", "class_id", (F.col("id") == F.col("class_id")).alias("kept")))


def drop_near_copies(df: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` whose document stands for its class; rows with a null id stay."""
    gone = written(near_classes(df, id_col, text_col, similarity).filter(~F.col("kept")).select("id"), "near-gone")
    rows = df.select(F.struct(*[col(c) for c in df.columns]).alias("row"))
    kept = rows.join(gone, F.col("row")[id_col].cast("long") == F.col("id"), "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in df.columns])
