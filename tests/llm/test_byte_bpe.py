from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from helpers import awkward_documents, document_table
from tidemark.llm import byte_bpe as bb

PARTS = [*"abcdeé ñß\n\t'sS.,!?0123½²Ⅷ_-x", "你好", "\x1c", "\x1f", "\x85", "\xa0", "　", "​", "'s", "'ll", " the", " \n",
         "<|endoftext|>", "🎉", "́", "अ"]


@pytest.fixture(scope="module")
def ranks():
    return bb.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_library_s(ranks, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["a" * 5000, " " * 3000 + "x", "xyz" * 900, "\n" * 50, "1" * 400, ""]
    tokenizer = bb.ByteTokenizer(ranks, public_tokenizers.PATTERN, {})
    for text, ids in zip(texts, tokenizer.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), text
        assert tokenizer.decode(ids) == text.encode()


def test_fold_over_distinct_words(spark, ranks, library):
    rng = random.Random(4)
    words = [("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))),) for _ in range(600)]
    got = bb.encode_words(spark.createDataFrame(words, "word string"), "word", ranks).collect()
    for r in got:
        want = library._core_bpe.encode_single_piece(r["word"].encode()) if r["word"] else []
        assert r["ids"] == want, r["word"]


def test_frequent_words_change_nothing(spark, ranks, library):
    docs = spark.createDataFrame([(f"the cat {i} and the dog's house",) for i in range(50)], "text string")
    frequent = bb.frequent_words(docs, public_tokenizers.PATTERN, ranks)
    assert " the" in frequent and frequent[" the"] == library.encode_ordinary(" the")
    tokenizer = bb.ByteTokenizer(ranks, public_tokenizers.PATTERN, frequent)
    text = "the cat 7 and the dog's house, unheard-of"
    assert tokenizer.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_awkward_rows(spark, ranks, library):
    rows = awkward_documents()
    docs = document_table(spark, rows)
    out = bb.encode_texts(docs, "doc_id", "text", ranks, public_tokenizers.PATTERN).collect()
    got = sorted(((r["id"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in out),
                 key=repr)
    want = sorted(((i, len(ids), ids, (t or "").encode())
                   for i, t in rows for ids in [library.encode_ordinary(t or "")]), key=repr)
    assert got == want
    assert bb.encode_digests(docs.limit(0), "doc_id", "text", ranks, public_tokenizers.PATTERN).count() == 0
