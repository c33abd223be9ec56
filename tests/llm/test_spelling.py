from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import awkward_documents, document_table
from tidemark.llm import spelling

SMALL = str.maketrans(spelling.UPPER, spelling.LOWER)


def brute_counts(rows, least=5):
    c = Counter()
    for doc, text in rows:
        for run in re.findall(spelling.RUN, text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % spelling.ALTERED == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= spelling.LEAST_LETTERS and n >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def brute_forms(n: dict):
    near = defaultdict(list)
    for a in n:
        for b in n:
            if one_edit(a, b):
                near[a].append(b)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x))
        if n[best] >= 5 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def variants(rng, word):
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abcÀÿ") + word[at:], word[:at] + "é" + word[at + 1 :]])


def stored(spark, n: dict):
    return spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)


@pytest.mark.parametrize("longest", [64, 8])
def test_forms_agree_with_brute_force(spark, longest):
    rng = random.Random(7)
    known = ["".join(rng.choice("abc") for _ in range(rng.randint(6, 9))) for _ in range(120)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab"]
    n = {w: rng.choice([5, 30, 200, 2000]) for w in known}
    for w in known:
        n[variants(rng, w)] = rng.choice([5, 6, 40])
        n[variants(rng, variants(rng, w))] = 5
    n = {w: c for w, c in n.items() if len(w) >= 6}
    got = sorted((tuple(r) for r in spelling.variant_forms(stored(spark, n), longest=longest).collect()), key=repr)
    assert got == brute_forms(n)


def test_long_words(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("xyz") for _ in range(size)) for size in (63, 64, 65, 66, 500, 20_000)]
    n = {w: 100 for w in base} | {"a" * 64: 7, "a" * 65: 50, "a" * 66: 5}
    for w in base:
        n[variants(rng, w)] = 9
        n[w[:-1] + "q"] = 8
    assert sorted((tuple(r) for r in spelling.variant_forms(stored(spark, n)).collect()), key=repr) == brute_forms(n)


def test_one_word_with_thousands_of_neighbours(spark):
    letters = [chr(c) for c in range(0xE0, 0x100)] + list("bcdefgh")
    n = {"a" * 30: 100_000} | {"a" * i + x + "a" * (29 - i): 5 + i for i in range(30) for x in letters}
    got = spelling.variant_forms(stored(spark, n))
    hub = got.filter(F.col("word") == "a" * 30).first()
    assert hub["n_near"] == len(n) - 1 and hub["form"] is None
    assert got.filter(F.col("root") == "a" * 30).count() == len(n)


def test_counts_and_awkward_rows(spark):
    rng = random.Random(3)
    rows = awkward_documents() + [
        (i, " ".join(rng.choice(["Straße", "ETERNITY", "eternity", "Éternel", "×÷×÷×÷", "d'accordement"]) for _ in range(50)))
        for i in range(1000, 1100)]
    docs = document_table(spark, rows).withColumns({"word": F.lit("w"), "run": F.lit("r"), "h": F.lit(1)})
    want = brute_counts(rows)
    got = spelling.word_counts(docs, "doc_id", "text")
    assert {r["word"]: r["n"] for r in got.collect()} == want
    assert len(want) > len({"straße", "eternity"})
    out = spelling.spelling_variants(docs, "doc_id", "text")
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_forms(want)
    assert spelling.spelling_variants(docs.limit(0), "doc_id", "text").count() == 0
