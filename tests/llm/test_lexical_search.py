from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import awkward_documents, document_table, words
from tidemark.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall(text.translate(SMALL)) if text is not None else []


def brute(rows, items, k):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    all_terms, n_docs = sum(n for _, _, n in docs), len(docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        found = []
        for doc, c, n in docs:
            m = 50 + (50 * n * n_docs) // all_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=repr)


def search(docs, items, k=10, **options):
    return sorted((tuple(r) for r in ls.ranked_documents(docs, "doc_id", "text", items, "item_id", "text", k, **options)
                   .collect()), key=repr)


@pytest.mark.parametrize("block_terms, cells", [(200_000, 1 << 24), (40, 500)])
def test_agrees_with_brute_force(spark, monkeypatch, block_terms, cells):
    monkeypatch.setattr(ls, "BLOCK_CELLS", cells)
    monkeypatch.setattr(ls, "AT_ONCE", 4)
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randint(1, 80), 400)) for i in range(300)] + [(i, "Abc abc ÉTÉ été x" * 2) for i in range(300, 340)]
    rows += [(7, rows[7][1]), (None, rows[7][1]), (400, None), (401, ""), (402, "... !"), (403, "long " * 5000)]
    items = [(i, words(rng, rng.randint(1, 90), 400)) for i in range(25)]
    items += [(3, items[3][1]), (3, "abc été"), (50, None), (51, ""), (52, "missing"), (53, "ÉTÉ ABC"), (None, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    queries = spark.createDataFrame(items, "item_id long, text string")
    got = search(docs, queries, block_terms=block_terms)
    assert got == brute(rows, items, 10)


def test_groups_with_low_bounds_are_not_evaluated(spark):
    rng = np.random.default_rng(1)
    n = np.full(4000, 10)
    terms_ = np.sort(rng.integers(0, 50, (4000, 6)), axis=1).astype(np.int32)
    terms_[:5] = np.arange(6)
    flat, doc = terms_.ravel(), np.repeat(np.arange(4000), 6)
    keep = np.r_[True, (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])]
    block = ls._Block(np.arange(4000), n, flat[keep], np.ones(keep.sum(), np.int64), doc[keep], 4000, 40000)
    looked = []

    class Seen(ls._Best):
        def add(self, scores, ids):
            looked.append(len(ids))
            super().add(scores, ids)

    best = Seen(5)
    block.rank(np.arange(6, dtype=np.int32), np.full(6, 1000), best)
    assert best.ids.tolist() == [0, 1, 2, 3, 4]
    assert sum(looked) < 1000


def test_masks_group_equal_columns():
    present = np.random.default_rng(2).random((70, 300)) < 0.02
    masks, group = ls._masks(present)
    assert (masks[:, group] == present).all()
    assert masks.shape[1] == len({tuple(c) for c in present.T.tolist()})


def test_awkward_rows(spark):
    rows = awkward_documents()
    docs = document_table(spark, rows).withColumns({"terms": F.lit(1), "tfs": F.lit(2), "item": F.lit(3), "score": F.lit(4)})
    items = spark.createDataFrame([(1, rows[5][1]), (2, "a" * 1500), (3, "été")], "item_id long, text string") \
        .withColumns({"id": F.lit(1), "terms": F.lit("x"), "rank": F.lit(0)})
    want = brute(rows, [(1, rows[5][1]), (2, "a" * 1500), (3, "été")], 10)
    assert search(docs, items) == want
    assert search(docs.limit(0), items) == [] and search(docs, items.limit(0)) == []
