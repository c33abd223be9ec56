from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helpers import awkward_documents, document_table
from tidemark.llm import packing as pk

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_ids_are_the_library_s(library):
    rng = random.Random(5)
    parts = [*"abcXYZéñß 019½²Ⅷ.,!?-_'\n\t", "the", "'s", "'LL", " ", "你好", "ΣΑΣ", "İ", "ǅ", "\x1c", "\x85", "\xa0", "́",
             "é", "<|endoftext|>", "🎉", "अ", "ſ", "ﬁ", "Å"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "ab" * 1000, "x" * 3000 + " y", "word " * 2000]
    tokenizer = pk.WordTokenizer(VOCABULARY)
    for text, raw in zip(texts, tokenizer.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def fewest(items: list[int], capacity: int) -> int:
    best = [len(items)]
    items = sorted(items, reverse=True)

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= items[k]:
                rest = list(bins)
                rest[rest.index(room)] -= items[k]
                place(k + 1, rest)
        place(k + 1, [*bins, capacity - items[k]])

    place(0, [])
    return best[0]


def test_plans_are_whole_and_near_the_optimum():
    rng = random.Random(3)
    more = 0
    for trial in range(150):
        capacity = rng.choice([10, 20, 50])
        low = 1 if trial % 2 else capacity // 5
        items = [rng.randint(low, capacity if trial % 2 else capacity // 2 + 1) for _ in range(rng.randint(1, 9))]
        plan = pk.plan_sequences(dict(Counter(items)), capacity)
        used = Counter()
        for times, filling in plan:
            assert sum(filling) <= capacity
            for n in filling:
                used[n] += times
        assert used == Counter(items)
        more += sum(t for t, _ in plan) - fewest(items, capacity)
    assert more <= 2


def test_completion_beats_best_fit():
    counts = {k: 40 for k in range(1200, 2100, 7)}
    plan = sum(t for t, _ in pk.plan_sequences(counts))
    assert pk.lower_bound(counts, 4096) <= plan < sum(t for t, _ in pk.best_fit(counts, 4096))


def check_pieces(rows, texts, library, capacity):
    ids = {}
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
        ids.setdefault(r["id"], []).append(r)
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for key, text in texts:
        full = library.encode(text or "", add_special_tokens=False).ids + [pk.CLOSING_ID]
        for k, start in enumerate(range(0, len(full), capacity)):
            part = np.array(full[start : start + capacity], "<u4")
            want[key, k, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    return len(by)


def test_awkward_rows(spark, library, monkeypatch):
    monkeypatch.setattr(pk, "ROWS_PER_BLOCK", 20)
    rows = awkward_documents()
    docs = document_table(spark, rows)
    for capacity in (64, 4096):
        packed = pk.pack_documents(docs, "doc_id", "text", VOCABULARY, capacity).collect()
        used = check_pieces(packed, rows, library, capacity)
        assert used <= -(-sum(r["length"] for r in packed) // capacity) + 1
    assert pk.pack_documents(docs.limit(0), "doc_id", "text", VOCABULARY).count() == 0
