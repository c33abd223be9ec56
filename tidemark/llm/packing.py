"""Packing of tokenized documents into sequences by bin completion.

Only lengths decide where a document fits, so the plan is made on the counts
of the lengths: at most ``capacity`` numbers, however many documents there
are. Bin completion takes the largest length left, enumerates fillings of the
rest of its sequence that no single longer document dominates, and goes depth
first through them; a branch whose waste exceeds what the best known plan
leaves is cut. The best-fit plan is the first incumbent. One filling is used
as often as its lengths last, so a plan has few different fillings.

Every document then gets its place by its rank among those of equal length.
Ranks are counted in salted blocks, so a length that many documents have is
no group of one task.

Defined results: a null or empty text is the closing id alone; only documents
longer than the capacity are cut. Rows that repeat an id are packed each for
itself; a null id is kept. Other columns are ignored, empty tables give empty
results.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.bpe_merges import PairTable, merge_words
from tidemark.llm.common import arrow_pieces, freed, replaced, written

CAPACITY = 4096
CLOSING_ID = 1
ROWS_PER_BLOCK = 50_000
#: Steps of the search for a better plan than the incumbent.
SEARCH_STEPS = 4_000
#: Fillings tried for one largest document.
BRANCHES = 3
FILL_STEPS = 2_000
#: Runs of text a task remembers the ids of.
REMEMBERED_RUNS = 400_000
#: The vocabulary's rule for words (fixed value).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters that Python's split takes for space and the vocabulary does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Characters beyond Latin Extended-B.
_DISTANT = re.compile("[^\x00-\u024f]")


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordTokenizer:
    """Ids of a vocabulary of words with ends, run by run of text without spaces.

    A run of plain letters is merged here, many runs at once; a run with
    characters beyond Latin Extended-B goes to the tokenizer library itself.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first = [vocabulary[a] for a, _ in merges]
        second = [vocabulary[b] for _, b in merges]
        merged = [vocabulary[a + b] for a, b in merges]
        self.table = PairTable(first, second, np.arange(len(merges)), merged, max(vocabulary.values()) + 1)
        names = _byte_names()
        self.inner = np.array([vocabulary[c] for c in names])
        self.last = np.array([vocabulary[c + "</w>"] for c in names])
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.known: dict[str, bytes] = {}

    def _direct(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, runs: list[str]) -> None:
        """Remember the ids of runs that are not known yet."""
        owners: list[int] = []
        words: list[str] = []
        plain: list[str] = []
        for run in runs:
            if run.isascii():
                low = run.lower()
            elif _DISTANT.search(run):
                self.known[run] = self._direct(run)
                continue
            else:
                low = unicodedata.normalize("NFC", run).lower()
            if low.isalpha():
                owners.append(len(plain))
                words.append(low)
            else:
                parts = WORDS.findall(low)
                owners.extend([len(plain)] * len(parts))
                words.extend(parts)
            plain.append(run)
        if not words:
            self.known.update(dict.fromkeys(plain, b""))
            return
        raw = np.frombuffer("\n".join(words).encode() + b"\n", np.uint8)
        ends = np.flatnonzero(raw == 10)  # no word holds a line break
        ids = self.inner[raw]
        ids[ends - 1] = self.last[raw[ends - 1]]
        ids, sizes = merge_words(np.delete(ids, ends), np.diff(ends, prepend=-1) - 1, self.table)
        per_run = np.bincount(np.array(owners), weights=sizes, minlength=len(plain))
        to = np.cumsum(4 * per_run.astype(np.int64)).tolist()
        flat = ids.astype("<u4").tobytes()
        self.known.update(zip(plain, [flat[i:j] for i, j in zip([0, *to], to, strict=False)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.known) > REMEMBERED_RUNS:
            self.known.clear()
        split = [None if _NOT_SPACE.search(t) else t.split() for t in texts]
        new = {r for runs in split if runs for r in runs}.difference(self.known)
        self.learn(sorted(new))
        known = self.known.__getitem__
        return [self._direct(t) if runs is None else b"".join(map(known, runs))
                for t, runs in zip(texts, split, strict=True)]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def forget_runs() -> None:
    """The tables of a vocabulary stay, the runs of texts go."""
    for tokenizer in _TOKENIZERS.values():
        tokenizer.known.clear()


def token_pieces(df: DataFrame, id_col: str, text_col: str, vocabulary: str,
                 capacity: int = CAPACITY) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` of each piece of each document."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = rows.drop("text").schema.add("piece", "integer").add("start", "long") \
        .add("length", "long").add("ids_crc32", "long")
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def run(batches):
        tokenizer = _tokenizer(vocabulary)
        for batch in arrow_pieces(batches, 1024):
            ids = tokenizer.encode([t or "" for t in batch.column("text").to_pylist()])
            out = []
            for row, raw in enumerate(ids):
                raw += closing
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    out.append((row, k, at // 4, len(part) // 4, zlib.crc32(part)))
            made = pd.DataFrame(out, columns=["row", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(made["row"])), pa.array(made["piece"], pa.int32()),
                 *(pa.array(made[c], pa.int64()) for c in ("start", "length", "ids_crc32"))],
                names=["id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(freed(run, forget_runs), schema)


Plan = list[tuple[int, tuple[int, ...]]]


def _fillings(counts: dict[int, int], room: int, branches: int = BRANCHES) -> list[tuple[int, ...]]:
    """Undominated sets of lengths that fit in ``room``, least waste first, fewer pieces first.

    The search stops at the first set that leaves no room, or after
    ``FILL_STEPS`` steps with the best sets so far.
    """
    lengths = sorted((n for n in counts if n <= room), reverse=True)
    if not lengths:
        return [()]
    falling = [-n for n in lengths]
    found: dict[int, tuple[int, ...]] = {room - lengths[0]: (lengths[0],)}
    taken: list[int] = []
    steps = 0

    def note(space: int) -> None:
        # a single document as long as the whole set dominates it
        if room - space > lengths[0] and (space not in found or len(taken) < len(found[space])):
            found[space] = tuple(taken)

    def search(start: int, space: int) -> bool:
        nonlocal steps
        steps += 1
        first = max(start, bisect_left(falling, -space))
        if first == len(lengths):
            note(space)
            return space == 0
        for i in range(first, len(lengths)):
            n = lengths[i]
            for k in range(min(counts[n], space // n), 0, -1):
                taken.extend([n] * k)
                full = search(i + 1, space - n * k)
                del taken[-k:]
                if full or steps > FILL_STEPS:
                    return full
        return False

    search(0, room)
    return [found[space] for space in sorted(found)[:branches]]


def _apply(counts: dict[int, int], filling: tuple[int, ...]) -> tuple[int, dict[int, int]]:
    """Use a filling as often as its lengths last."""
    need: dict[int, int] = {}
    for n in filling:
        need[n] = need.get(n, 0) + 1
    times = min(counts[n] // k for n, k in need.items())
    left = {n: c - times * need.get(n, 0) for n, c in counts.items()}
    return times, {n: c for n, c in left.items() if c}


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on counts: the fullest sequence with room takes the next length."""
    open_bins: dict[int, dict[tuple[int, ...], int]] = {}
    plan: Plan = []
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            room = min((r for r in open_bins if r >= n), default=None)
            if room is None:
                # new sequences hold as many of this length as fit
                per = min(capacity // n, left)
                times = left // per
                filling = (n,) * per
                space, count = capacity - n * per, times
                left -= times * per
            else:
                filling, have = next(iter(open_bins[room].items()))
                count = min(have, left)
                if have == count:
                    del open_bins[room][filling]
                    if not open_bins[room]:
                        del open_bins[room]
                else:
                    open_bins[room][filling] = have - count
                filling, space = (*filling, n), room - n
                left -= count
            at = open_bins.setdefault(space, {})
            at[filling] = at.get(filling, 0) + count
    for bins in open_bins.values():
        plan.extend((times, filling) for filling, times in bins.items())
    return plan


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No plan has fewer sequences: total length, and lengths no two of which fit together."""
    total = -(-sum(n * c for n, c in counts.items()) // capacity)
    return max(total, sum(c for n, c in counts.items() if 2 * n > capacity))


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """(times, lengths) of each kind of sequence; every length is used as often as it occurs."""
    counts = {n: c for n, c in counts.items() if c}
    if not counts:
        return []
    best = best_fit(counts, capacity)
    fewest = sum(t for t, _ in best)
    bound = lower_bound(counts, capacity)
    total = sum(n * c for n, c in counts.items())
    steps = 0
    #: (lengths left, plan so far, sequences so far, waste so far), deepest first
    stack: list[tuple[dict[int, int], Plan, int, int]] = [(counts, [], 0, 0)]
    while stack and fewest > bound and steps < SEARCH_STEPS:
        left, plan, used, waste = stack.pop()
        steps += 1
        if not left:
            if used < fewest:
                best, fewest = plan, used
            continue
        if waste > (fewest - 1) * capacity - total:
            continue  # the plan would not have fewer sequences
        largest = max(left)
        rest = {n: c - (n == largest) for n, c in left.items()}
        rest = {n: c for n, c in rest.items() if c}
        choices = _fillings(rest, capacity - largest)
        for filling in reversed(choices):
            times, after = _apply(left, (largest, *filling))
            lost = times * (capacity - largest - sum(filling))
            stack.append((after, [*plan, (times, (largest, *filling))], used + times, waste + lost))
    return best


def _runs(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank of each run, its first sequence, its offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, filling in plan:
        offset = 0
        for n in filling:
            at = used.get(n, 0)
            runs.setdefault(n, []).append((at, sequence, offset))
            used[n] = at + times
            offset += n
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in runs.items()}


def pack_documents(df: DataFrame, id_col: str, text_col: str, vocabulary: str,
                   capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``."""
    spark = df.sparkSession
    rows = written(token_pieces(df, id_col, text_col, vocabulary, capacity), "packing-pieces")
    counts = {r["length"]: r["n"] for r in
              rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    blocks = max(1, -(-sum(counts.values()) // ROWS_PER_BLOCK))
    runs = spark.sparkContext.broadcast(_runs(plan_sequences(counts, capacity)))
    salted = rows.withColumn("block", F.pmod(F.xxhash64("id", "piece"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(
        salted.groupBy("length", "block").agg(F.count("*").alias("n"))
        .select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packing-bases")
    inside = Window.partitionBy("length", "block").orderBy("id", "piece", "ids_crc32")
    ranked = (salted.withColumn("place", F.row_number().over(inside) - 1)
              .join(bases, ["length", "block"]).withColumn("rank", F.col("base") + F.col("place"))
              .select("id", "piece", "start", "length", "ids_crc32", "rank"))
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches):
        where = runs.value
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence = np.empty(len(lengths), np.int64)
            offset = np.empty(len(lengths), np.int64)
            for n in np.unique(lengths):
                mine = lengths == n
                first, start, at = where[int(n)]
                i = np.searchsorted(first, ranks[mine], "right") - 1
                sequence[mine] = start[i] + ranks[mine] - first[i]
                offset[mine] = at[i]
            yield replaced(batch, "rank", sequence_id=pa.array(sequence), offset=pa.array(offset))

    return ranked.mapInArrow(place, schema)
