from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from helpers import awkward_documents, document_table, words
from tidemark.llm import suffix_dedup as sd
from tidemark.llm.induced_sort import common_prefixes, suffix_array


def brute(rows, length=sd.LENGTH):
    seen = Counter()
    for _, text in rows:
        raw = (text or "").encode()
        seen.update(raw[p : p + length] for p in range(len(raw) - length + 1))
    out = []
    for key, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if seen[raw[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out.append((key, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted([tuple(r) for r in sd.remove_repeats(df, "doc_id", "text", digest=True).collect()], key=repr)


def documents():
    rng = random.Random(5)
    passages = [words(rng, 70) for _ in range(4)]
    rows = []
    for i in range(70):
        text = words(rng, rng.randint(0, 100))
        if rng.random() < 0.5:
            text += " " + rng.choice(passages) + " " + words(rng, 20)
        if rng.random() < 0.3:
            part = rng.choice(passages)
            start = rng.randint(0, len(part) // 3)
            text = part[start : start + rng.randint(180, 260)] + text
        if rng.random() < 0.2 and rows:
            base = rng.choice(rows)[1]
            k = rng.randint(0, len(base))
            text = base[:k] + "é" + base[k + 1 :]
        rows.append((i, text))
    return rows + [(200, "a" * 600), (201, "a" * 199), (202, "ab" * 300), (203, "aab" * 150 + "x" + "aab" * 150),
                   (204, "ü" * 250), (205, "\x00" * 400), (206, "a" * 201)]


def test_agrees_with_brute_force(spark):
    rows = documents()
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


@pytest.mark.parametrize(("name", "value"), [("SHARD_CONTEXTS", 2), ("PART", 700), ("SHARD_BYTES", 5000)])
def test_other_sizes_same_result(spark, monkeypatch, name, value):
    monkeypatch.setattr(sd, name, value)
    rows = documents()
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_awkward_rows(spark):
    rows = awkward_documents()
    docs = document_table(spark, rows)
    assert found(docs) == brute(rows)
    assert found(docs.limit(0)) == []
    kept = {r["id"]: r["kept"] for r in sd.remove_repeats(docs, "doc_id", "text").collect()}
    assert kept[100] == b"" and kept[102] == b""


def test_least_runs_are_the_leftmost():
    runs = np.random.default_rng(1).integers(0, 40, 140_000).astype(np.uint64) << np.uint64(20)
    windows = np.lib.stride_tricks.sliding_window_view(runs, sd.BEFORE + 1)
    assert (sd._least_runs(runs) == windows.argmin(axis=1) + np.arange(len(windows))).all()


@pytest.mark.parametrize("contexts", [sd.SHARD_CONTEXTS, 0])
def test_stretch_over_a_multiple_of_65536(spark, monkeypatch, contexts):
    monkeypatch.setattr(sd, "SHARD_CONTEXTS", contexts)
    rng = random.Random(12)
    rows = [(1, words(rng, 30_000)[: 65_536 - 110] + "a" * 250 + words(rng, 60)),
            (2, words(rng, 30_000)[: 65_536 - 120] + "xyz" * 90 + words(rng, 60))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_suffix_arrays_and_prefixes():
    rng = random.Random(1)
    for t in range(400):
        n, k = rng.randint(1, 60), rng.choice([1, 2, 3, 5])
        text = [rng.randint(1, k) for _ in range(n)]
        if t % 3 == 0:
            text = (text[: n // 3 + 1] * 3)[:n]
        text = np.array([*text, 0])
        want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        sa = suffix_array(text, k + 1)
        assert sa.tolist() == want
        near = suffix_array(text, k + 1, 6)
        assert [text[i : i + 6].tolist() for i in near] == [text[i : i + 6].tolist() for i in want]
        padded = np.append(text, np.zeros(12, int))
        got = common_prefixes(padded, sa, np.arange(len(text) - 1), 8)
        for rank in range(1, len(sa)):
            a, b = int(sa[rank]), int(sa[rank - 1])
            if a < len(text) - 1:
                shared = 0
                while shared < 8 and padded[a + shared] == padded[b + shared] and max(a, b) + shared < len(text):
                    shared += 1
                assert got[a] == shared or max(a, b) + min(got[a], shared) >= len(text) - 1
