"""Removal of every byte that a repeated string of 200 bytes covers.

Where can such a string be? Every string of 200 bytes holds 169 runs of 32
bytes; the run whose hash is the least is its anchor, at the same place
wherever the string occurs. So equal strings have equal anchors, and only
anchors that occur more than once matter. The context of an anchor is made of
the neighbouring strings that have it as theirs, about 285 bytes; every string
is in one context.

Occurrences of an anchor with equal contexts repeat every string in them.
Where contexts of one anchor differ, the distinct ones go to shards, by
anchor. A shard's contexts are one text; its suffix array is induced (see
``induced_sort``), permuted common prefixes of 200 bytes and more show which
strings occur at more than one place. An anchor with more contexts than a
shard takes is decided by counting the hashes of its strings instead.

Strings are judged on the input; matches do not cross documents; overlaps
count. Nothing is gathered per anchor: anchors are counted, joined in equi
joins that Spark can split, and only distinct contexts meet in a shard.

Defined results: a null text is empty. Texts under 200 bytes lose nothing.
Repeated rows repeat each other. A null id is an id like another. Other
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import MIX_A, MIX_B, MIX_C, mix64, pieces, signed, written
from tidemark.llm.induced_sort import common_prefixes, suffix_array

LENGTH = 200
RUN = 32
BEFORE = LENGTH - RUN
#: Texts are scanned in parts of this many bytes.
PART = 1 << 20
SHARD_BYTES = 2_000_000
#: Distinct contexts of one anchor that a shard takes.
SHARD_CONTEXTS = 16_384
NULL_ID = -(1 << 63)

_ODD = (MIX_A, MIX_C)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and those of its inverse."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for odd in (base, pow(base, -1, 1 << 64)):
            row = np.empty(size, np.uint64)
            row[0] = 1
            done = 1
            with np.errstate(over="ignore"):
                while done < size:
                    row[done : 2 * done] = row[:done] * np.uint64(pow(odd, done, 1 << 64))
                    done *= 2
            both.append(row)
        held = _POWERS[base] = (both[0], both[1])
    return held


class _Hashes:
    """Hash of any range of a byte string from its running sums."""

    def __init__(self, data: np.ndarray, base: int):
        self.up, self.down = _powers(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.down[start])


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best of each ``width`` neighbours: ranges of a power of two, two of which overlap."""
    span = 1
    while 2 * span <= width:
        values = best(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def _least_runs(runs: np.ndarray) -> np.ndarray:
    """Place of the least run of every string; of equal runs the leftmost."""
    found = []
    step = (1 << 16) - BEFORE
    for start in range(0, len(runs) - BEFORE, step):
        own = runs[start : start + step + BEFORE]
        # the low bits are the place in this block, which has no more than they can tell
        marked = (own & ~np.uint64(0xFFFF)) | np.arange(len(own), dtype=np.uint64)
        least = _sliding(marked, BEFORE + 1, np.minimum) & np.uint64(0xFFFF)
        found.append(least.astype(np.int64) + start)
    return np.concatenate(found)


def anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts of the anchors of a text, their hashes, the hashes and both sizes of their contexts."""
    found: list[tuple[np.ndarray, ...]] = []
    n = len(data)
    for core in range(0, n, PART):
        part = data[core : min(n, core + PART + LENGTH - 1)]
        if len(part) < LENGTH:
            continue
        ranges = _Hashes(part, _ODD[0])
        at = np.arange(len(part) - RUN + 1)
        runs = ranges.of(at, at + RUN)
        chosen = _least_runs(runs)
        first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
        last = np.r_[first[1:], len(chosen)] - 1
        chosen = chosen[first]
        left, end = chosen - first, last + LENGTH
        context = _Hashes(part, _ODD[1]).of(first, end)
        with np.errstate(over="ignore"):
            context ^= mix64(left.astype(np.uint64) * np.uint64(MIX_B) + (end - chosen).astype(np.uint64))
        found.append((chosen + core, runs[chosen], context, left, end - chosen))
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8"), np.uint8)


def _anchor_rows(batches):
    for batch in pieces(batches):
        parts = []
        for key, mark, text in zip(batch["id"].tolist(), batch["mark"].tolist(), batch["text"], strict=True):
            at, run, context, left, right = anchors(_bytes(text))
            parts.append(pd.DataFrame({"id": key, "mark": mark, "a": signed(run), "c": signed(context),
                                       "at": at << 16 | left << 8 | right}))
        yield pd.concat(parts)


def _contexts(batches):
    """The bytes of the contexts that are asked for, per document."""
    for batch in pieces(batches, 32):
        out = []
        for key, mark, text, wanted in zip(batch["id"], batch["mark"], batch["text"], batch["wanted"], strict=True):
            data = text.encode("utf-8")
            for w in wanted:
                start, left, right = w["at"] >> 16, w["at"] >> 8 & 255, w["at"] & 255
                out.append((w["a"], w["c"], key, mark, start - left, left, data[start - left : start + right]))
        yield pd.DataFrame(out, columns=["a", "c", "id", "mark", "start", "left", "bytes"])


def _repeated_in_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Covered ranges, in each context, of the strings that occur at more than one place of the shard."""
    rows = rows.sort_values(["a", "c"])
    sizes = rows["bytes"].map(len).to_numpy()
    starts = np.cumsum(sizes + 1) - sizes - 1
    # bytes are 2 to 257, a 1 ends each context, the 0 ends the text
    text = np.concatenate([np.frombuffer(b"\x00".join(rows["bytes"]) + b"\x00\x00", np.uint8).astype(np.int64) + 2])
    text[starts + sizes] = 1
    text[-1] = 0
    sa = suffix_array(text, 258, LENGTH)
    strings = np.maximum(sizes - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(rows)), strings)
    offset = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
    position = starts[owner] + offset
    padded = np.append(text, np.zeros(LENGTH + 4, np.int64))
    shared = common_prefixes(padded, sa, position, LENGTH)
    which = np.full(len(text), -1, np.int64)
    which[position] = np.arange(len(position))
    ordered = which[sa]
    ordered = ordered[ordered >= 0]
    # neighbours that share a whole string form a class; it repeats if it holds two places
    document = pd.factorize(pd.MultiIndex.from_arrays([rows["id"].to_numpy(), rows["mark"].to_numpy()]))[0]
    place = (document.astype(np.int64) << 40)[owner] + rows["start"].to_numpy()[owner] + offset
    repeated = np.zeros(len(position), bool)
    if len(ordered):
        first = np.flatnonzero(np.r_[True, shared[ordered][1:] < LENGTH])
        lo = np.minimum.reduceat(place[ordered], first)
        hi = np.maximum.reduceat(place[ordered], first)
        repeated[ordered] = np.repeat(lo < hi, np.diff(np.r_[first, len(ordered)]))
    hit = pd.DataFrame({"owner": owner[repeated], "offset": offset[repeated]})
    lists = hit.groupby("owner")["offset"].agg(list)
    out = rows.iloc[lists.index][["a", "c"]].copy()
    out["starts"] = [_runs_of(x) for x in lists]
    return out


def _runs_of(starts: list[int]) -> list[int]:
    """Covered ranges, as start, end, start, end ..., of strings at the given starts."""
    ranges: list[int] = []
    for s in starts:
        if ranges and s <= ranges[-1]:
            ranges[-1] = s + LENGTH
        else:
            ranges.extend((s, s + LENGTH))
    return ranges


def _string_hashes(batches):
    for batch in pieces(batches):
        out = []
        for a, c, left, data in zip(batch["a"], batch["c"], batch["left"], batch["bytes"], strict=True):
            n = len(data) - LENGTH + 1
            if n > 0:
                at = np.arange(n)
                held = np.frombuffer(data, np.uint8)
                out.append(pd.DataFrame({
                    "a": a, "c": c, "offset": at, "ahead": left - at, "h": signed(_Hashes(held, _ODD[0]).of(at, at + LENGTH)),
                    "g": signed(_Hashes(held, _ODD[1]).of(at, at + LENGTH))}))
        yield pd.concat(out) if out else pd.DataFrame(columns=["a", "c", "offset", "ahead", "h", "g"], dtype="int64")


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """``id, mark, ranges``: covered byte ranges (unmerged) of the texts that have any."""
    every = written(texts.mapInPandas(_anchor_rows, "id long, mark long, a long, c long, at long"), "suffix-anchors")
    often = written(every.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"), "suffix-often")
    rows = written(every.join(often, "a").select("a", "c", "id", "mark", "at"), "suffix-rows")
    forms = written(
        rows.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("id", "mark", "at")).alias("one")).select("a", "c", "n", "one.*"), "suffix-forms")
    mixed = written(forms.groupBy("a").agg(F.count("*").alias("forms"), F.min("n").alias("rarest")) \
        .filter("forms > 1 AND rarest = 1").select("a", "forms"), "suffix-mixed")
    asked = forms.join(mixed, "a").groupBy("id", "mark").agg(
        F.collect_list(F.struct("a", "c", "at")).alias("wanted"))
    contexts = written(
        texts.join(written(asked, "suffix-asked"), ["id", "mark"]).dropDuplicates(["id", "mark"])
        .mapInPandas(_contexts, "a long, c long, id long, mark long, start long, left int, bytes binary")
        .join(mixed, "a"), "suffix-contexts")
    total = contexts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    sorted_ranges = contexts.filter(F.col("forms") <= SHARD_CONTEXTS) \
        .groupBy(F.pmod(F.xxhash64("a", F.lit(3)), F.lit(shards)).alias("shard")) \
        .applyInPandas(lambda rows: _repeated_in_shard(rows), "a long, c long, starts array<int>")
    strings = contexts.filter(F.col("forms") > SHARD_CONTEXTS).mapInPandas(
        _string_hashes, "a long, c long, offset long, ahead long, h long, g long")
    often_strings = written(strings.groupBy("a", "ahead", "h", "g").agg(F.count("*").alias("n")).filter("n > 1")
                            .drop("n"), "suffix-strings")
    runs = F.udf(lambda starts: _runs_of(sorted(starts)), "array<int>")
    counted_ranges = strings.join(often_strings, ["a", "ahead", "h", "g"]).groupBy("a", "c").agg(
        F.collect_set(F.col("offset").cast("int")).alias("offsets")).select("a", "c", runs("offsets").alias("starts"))
    whole = forms.filter("n > 1").select(
        "a", "c", F.array(F.lit(0), (F.shiftright("at", 8).bitwiseAND(F.lit(255)) + F.col("at").bitwiseAND(F.lit(255)))
                          .cast("int")).alias("starts"))
    partly = written(sorted_ranges.unionByName(counted_ranges), "suffix-partly") \
        .join(whole.select("a", "c"), ["a", "c"], "left_anti")
    covered = written(whole.unionByName(partly), "suffix-covered")
    base = (F.shiftright("at", 16) - F.shiftright("at", 8).bitwiseAND(F.lit(255))).alias("base")
    return (rows.join(covered, ["a", "c"]).select("id", "mark", base, "starts")
            .select("id", "mark", F.transform("starts", lambda s: s + F.col("base")).alias("ranges"))
            .groupBy("id", "mark").agg(F.flatten(F.collect_list("ranges")).alias("ranges")))


def _merged(ranges) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    pairs = np.asarray(ranges, np.int64).reshape(-1, 2)
    for a, b in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(df: DataFrame, id_col: str, text_col: str, *, digest: bool = False) -> DataFrame:
    """``id, n_bytes, spans, kept`` of every row: what stays, and the removed runs as start, end, ...

    With ``digest``: ``id, n_bytes, n_removed, n_spans, kept_sha256`` instead.
    """
    texts = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                      F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "mark", F.xxhash64("id", "text"))
    found = written(repeated_ranges(texts), "suffix-ranges")
    joined = texts.join(found, ["id", "mark"], "left").select("id", "text", "ranges")
    schema = "id long, n_bytes long, " + (
        "n_removed long, n_spans long, kept_sha256 string" if digest else "spans array<long>, kept binary")

    def run(batches):
        for batch in pieces(batches):
            out = []
            for key, text, ranges in zip(batch["id"].tolist(), batch["text"], batch["ranges"], strict=True):
                data = text.encode("utf-8")
                spans = _merged(ranges) if ranges is not None else []
                edges = [0, *(e for s in spans for e in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                key = None if key == NULL_ID else key
                if digest:
                    out.append((key, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
                else:
                    out.append((key, len(data), edges[1:-1], kept))
            made = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
            made["id"] = made["id"].astype("Int64")
            yield made

    return joined.mapInPandas(run, schema)
