from __future__ import annotations

import hashlib
import random
import re

import pytest

from helpers import awkward_documents, document_table, words
from tidemark.llm import pii


def brute(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def test_base_spans_agree_with_the_patterns():
    rng = random.Random(1)
    parts = ["a", ".", "@", "1", "9", "0", "25", "255", "256", "-", " ", "+", "(", ")", "é", "x@y.z", "1.2.3.4",
             "4111111111111111", "+1 (437) 555-0689", "%", "_", "\n", "٣"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == brute(text), text


@pytest.mark.parametrize("text", ["1" * 50_000, "a" * 50_000 + "@", "@" * 20_000, "+1" + " " * 50_000, "1." * 30_000])
def test_long_runs_end_soon(text):
    assert pii.base_spans(text) == pii.base_spans(text)
    pii.candidate_spans(text)


def test_fit_selects_what_looks_like_the_base(spark):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        phone = f"+{rng.randint(1, 99)} {rng.randint(200, 999)} {rng.randint(1000000, 9999999)}"
        junk = f"#{rng.randint(10**9, 10**10)}"
        rows.append((i, f"please call {phone} soon" if i % 3 else f"order {junk} was sent"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit_trees(docs, "text")
    assert model.trees and model.thresholds[3] <= 1
    base, every = pii.all_spans("please call 49 431 5550689 soon", model)
    assert base == [] and all(k == 3 for k, _, _ in every)
    found = pii.detect_pii(docs, "doc_id", "text", model).collect()
    text = dict(rows)
    for r in found:
        want = brute(text[r["id"]])
        assert r["base_sha256"] == hashlib.sha256(pii.span_list(want).encode()).hexdigest()
        assert set(pii.span_list(want).split(",")) <= set(r["spans"].split(",")) or not want


def test_threshold_is_the_lowest_that_is_nearly_always_right():
    import numpy as np

    scores = np.r_[np.linspace(1, 0.5, 100), np.linspace(0.4, 0, 50)]
    right = np.r_[np.ones(100), np.zeros(50)]
    assert 0.36 < pii._threshold(scores, right) <= 0.5
    assert pii._threshold(scores[:5], right[:5]) == 2.0
    assert pii._threshold(np.array([]), np.array([])) == 2.0


def test_awkward_rows(spark):
    rows = [*awkward_documents(), (300, "mail me@home.example or 10.0.0.1"), (301, "x@y.zz 1.2.3.4 +1 (437) 555-0689")]
    docs = document_table(spark, rows)
    model = pii.fit_trees(docs, "text")
    found = pii.detect_pii(docs, "doc_id", "text", model).collect()
    assert len(found) == len(rows)
    got = {r["id"]: r for r in found}
    assert got[100]["spans"] == "" and got[100]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[300]["n_email"] == 1 and got[300]["n_ip"] == 1
    out = pii.redact_pii(docs, "text", model)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[300] == "mail [EMAIL] or [IP]"
    assert texts[301] == "[EMAIL] [IP] [PHONE]"
    assert texts[100] is None
    assert pii.detect_pii(docs.limit(0), "doc_id", "text", pii.fit_trees(docs.limit(0), "text")).count() == 0


def test_redaction_joins_overlaps():
    assert pii.redact("0123456789", [(0, 2, 5), (3, 4, 7)]) == "01[EMAIL]789"
    assert pii.redact("0123456789", [(2, 0, 10)]) == "[CARD]"
    assert pii.redact(None, []) is None


def _number(rng, n):
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng):
    return next(c for c in iter(lambda: "4" + _number(rng, 15), None) if pii._luhn(c))


@pytest.fixture(scope="module")
def disguised_model(spark):
    """Fitted on base spans, on other numbers and sentences, and on a few disguised spans."""
    rng = random.Random(3)
    texts = []
    for i in range(400):
        a, b = words(rng, 4), words(rng, 4)
        texts += [f"{a} {rng.choice('abc')}{i}@mail{i % 9}.example.com {b}", f"{a} 10.{i % 256}.{i % 199}.7 {b}",
                  f"{a} {_card(rng)} {b}", f"{a} +1 (437) 555-{_number(rng, 4)} {b}",
                  f"{a} order #{_number(rng, 10)} was sent {b}", f"{a} id=ab{_number(rng, 16)}cd {b}",
                  f"{a} look at it. Then {b}"]
        if i % 10 == 0:
            texts.append(f"{a} 437 555-{_number(rng, 4)} {b}")
    return pii.fit_trees(spark.createDataFrame([(t,) for t in texts], "text string"), "text")


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("abc de 437-555-0123 fa be", 3, "437-555-0123"),
    ("abc de 4111.1111.1111.1111 fa be", 2, "4111.1111.1111.1111"),
    ("abc de b17(at)mail3.example.com fa be", 0, "b17(at)mail3.example.com"),
    ("abc de b17 at mail3 dot example dot com fa be", 0, "b17 at mail3 dot example dot com"),
    ("abc de 10[.]5[.]9[.]7 fa be", 1, "10[.]5[.]9[.]7"),
    ("abc de 1 . 2 . 3 . 4 fa be", 1, "1 . 2 . 3 . 4"),
])
def test_disguised_spans_are_added(disguised_model, text, kind, span):
    base, every = pii.all_spans(text, disguised_model)
    assert base == []
    assert [(k, text[a:b]) for k, a, b in every] == [(kind, span)]


@pytest.mark.parametrize("text", ["abc order #8264019375 was sent de", "abc id=ab8264019375826401cd de",
                                  "abc de look at it. Then fa"])
def test_other_candidates_are_not_added(disguised_model, text):
    assert pii.candidate_spans(text) and pii.all_spans(text, disguised_model) == ([], [])


def test_unlabelled_candidates_count_as_right_where_they_look_like_it():
    import numpy as np

    known = np.linspace(0.5, 1, 200)
    junk = np.linspace(0, 0.4, 500)
    assert 0.39 < pii._unlabelled_threshold(known, np.r_[junk, np.linspace(0.5, 1, 80)]) < 0.52
    assert 0.4 < pii._unlabelled_threshold(known, junk) <= 0.5
    assert pii._unlabelled_threshold(known, np.linspace(0.3, 0.9, 500)) > 0.85
    assert pii._unlabelled_threshold(known[:0], junk) == 2.0


def test_every_text_is_learned_from(spark):
    rng = random.Random(5)
    texts = [f"{words(rng, 3)} order #{_number(rng, 10)} was sent, number {i}" for i in range(21_000)]
    rows = pii._all_examples(spark.createDataFrame([(t,) for t in texts + texts[:500]], "text string"))
    assert rows.filter("kind = 3").count() == sum(s[0] == 3 for t in texts for s in pii.candidate_spans(t))
    # one copy of a text is as good as many, in any order
    fewer = pii._all_examples(spark.createDataFrame([(t,) for t in texts[::-1]], "text string"))
    assert rows.exceptAll(fewer).isEmpty() and fewer.exceptAll(rows).isEmpty()
