from __future__ import annotations

import random
import re
import time
import tracemalloc
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash

from pyspark.sql import functions as F

from helpers import awkward_documents, document_table, words
from tidemark.llm import near_dedup as nd
from tidemark.llm.components import connected_components


def classes(rows) -> dict:
    """Smallest id of each class, from all pairs."""
    rows = [(i, t) for i, t in rows if i is not None]
    counted = next(iter(nd._count_words([pd.DataFrame({"text": [t for _, t in rows]})])))
    counts = np.zeros(nd.WORD_BUCKETS + 1)
    counts[counted["bucket"]] = counted["n"]
    idf = (1 + np.log((1 + counts[-1]) / (1 + counts[:-1]))).astype(np.float32)
    vectors = [nd.shingle_weights(nd.word_codes(t), idf) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if len(vectors[a][0]) and len(vectors[b][0]) and nd.weighted_jaccard(vectors[a], vectors[b]) >= nd.SIMILARITY:
            root[find(b)] = find(a)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: least[find(k)] for k, (i, _) in enumerate(rows)}


def test_agrees_with_all_pairs(spark):
    rng = random.Random(1)
    rows = []
    for group in range(12):
        base = words(rng, 120).split()
        rows.append((group * 100, " ".join(base)))
        for k in range(1, 9):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "edit"
            rows.append((group * 100 + k, " ".join(copy)))
    got = {r["id"]: r["class_id"] for r in nd.near_classes(
        spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == classes(rows)


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_ROWS", 20)
    rng = random.Random(6)
    base = words(rng, 200).split()
    rows = []
    for k in range(90):
        copy = list(base)
        copy[rng.randrange(200)] = f"edit{k}"
        rows.append((k, " ".join(copy)))
    got = {r["class_id"] for r in nd.near_classes(
        spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {0}


def test_group_around_the_similarity(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_ROWS", 20)
    monkeypatch.setattr(nd, "TEXT_ROWS", 6)
    rng = random.Random(8)
    base = words(rng, 200).split()
    rows = []
    for k in range(70):
        copy = list(base)
        for place in rng.sample(range(5, 195), 2 + k % 3):
            copy[place] = f"edit{k}"
        rows.append((k, " ".join(copy)))
    got = {r["id"]: r["class_id"] for r in nd.near_classes(
        spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    want = classes(rows)
    assert got == want and 1 < len(set(want.values())) < 70


def test_awkward_rows(spark):
    rows = awkward_documents()
    docs = document_table(spark, rows)
    got = {r["id"]: (r["class_id"], r["kept"]) for r in nd.near_classes(docs, "doc_id", "text").collect()}
    want = classes(rows)
    assert {i: c for i, (c, _) in got.items()} == want
    assert all(kept == (i == c) for i, (c, kept) in got.items())
    left = nd.drop_near_copies(docs, "doc_id", "text")
    assert left.columns == docs.columns
    assert left.filter("doc_id IS NULL").count() == 2
    assert {r["doc_id"] for r in left.collect()} - {None} == {i for i, c in want.items() if i == c}
    assert nd.near_classes(docs.limit(0), "doc_id", "text").count() == 0


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    agree, share = [], []
    for _ in range(200):
        h = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
        w = rng.uniform(1, 8, len(h)).astype(np.float32)
        cut = rng.integers(5, len(h))
        other = (h[:cut], w[:cut])
        agree.append((nd.weighted_samples(h, w) == nd.weighted_samples(*other)).mean())
        share.append(nd.weighted_jaccard((h, w), other))
    assert abs(np.mean(agree) - np.mean(share)) < 0.02
    assert np.corrcoef(agree, share)[0, 1] > 0.9


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(500, 600)] + [(1, k) for k in range(700, 760)] + [(k, k) for k in (3, 4)]
    nodes = list(range(1000, 1200))
    edges += [tuple(rng.sample(nodes, 2)) for _ in range(150)]
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(root) if any(x in e and e[0] != e[1] for e in edges)}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["component"] for r in got.collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clashing_names_do_not_matter(spark):
    docs = document_table(spark, awkward_documents())
    for name in ("__gone", "row", "rep", "class_id", "kept"):
        docs = docs.withColumn(name, F.lit(7))
    out = nd.drop_near_copies(docs, "doc_id", "text")
    assert out.columns == docs.columns
    assert {r["__gone"] for r in out.collect()} == {7}


def _peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_task_holds_little_memory_however_many_words_and_pairs():
    texts = [" ".join(f"w{i}" for i in range(k, k + 20_000)) for k in range(0, 400_000, 20_000)]

    def read():
        for text in texts:
            nd.word_codes(text)

    try:
        assert _peak_mb(read) < 25
    finally:
        nd.forget_words()
    n = 600  # members of a block that are all alike
    rows = pd.DataFrame({"key": 1, "one": 0, "two": 0, "mine": 0, "band": 0, "id": range(n), "component": range(n),
                         "samples": [np.zeros(nd.SAMPLES, np.int32)] * n})
    held, side, group = nd._meetings(rows)
    count = 0

    def compare():
        nonlocal count
        count = sum(len(p) for p, *_ in nd._ends(held, side, group))

    assert _peak_mb(compare) < 25
    assert count == n * (n - 1) // 2


def test_words_have_the_hash_of_their_letters():
    rng = random.Random(12)
    alphabet = [chr(c) for a, b in ((32, 127), (160, 384), (880, 1280), (0x3040, 0x30FF), (0x1D400, 0x1D410), (0x1F600, 0x1F610))
                for c in range(a, b)]
    texts = [None, "", " ", "a", "x" * 31, "x" * 32 + " " + "y" * 100, "\n\nb\x00c\x85d _1", "\u0130 \u03a3\u0391\u03a3.\u03a3 \udc80e"]
    texts += ["".join(rng.choices(alphabet, k=rng.randrange(300))) for _ in range(300)]
    texts += ["word " * 60_000, None, "last"]  # more than is read at a time
    try:
        found = list(nd.codes_of_texts(texts))
        assert len(found) == len(texts)
        for text, codes in zip(texts, found, strict=True):
            want = [xxhash.xxh64_intdigest(w.encode()) for w in re.findall(r"\w+", (text or "").lower())]
            assert codes.dtype == np.uint64 and codes.tolist() == want
            assert nd.word_codes(text).tolist() == want
    finally:
        nd.forget_words()


def _least_seconds(run) -> float:
    took = []
    for _ in range(3):
        start = time.process_time()
        run()
        took.append(time.process_time() - start)
    return min(took)


def test_hashing_words_takes_less_than_cutting_them_out_one_by_one():
    rng = random.Random(13)
    words = ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(2, 10))) for _ in range(20_000)]
    text = " ".join(rng.choices(words, k=200_000))
    nd.word_codes("warm")
    assert _least_seconds(lambda: nd.word_codes(text)) < _least_seconds(lambda: re.findall(r"\w+", text.lower()))
