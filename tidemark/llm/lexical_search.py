"""Ranked lexical search over all documents, by the terms a document shares with an item.

One pass over the texts writes every document's length and its counts of the
items' terms; document frequencies, the number of documents and of terms come
from that table. The second pass ranks. Its tasks hold a block of documents as
a matrix (term, document) of score parts. For every item the presence bits of
its terms are packed into one mask per document, and documents with equal
masks form a group. A group's score is at most the sum, over the terms of its
mask, of what the group's shortest document would get for the block's highest
count of the term, and no more than the block's best part of that term. Groups
are evaluated from the highest bound down, until the bound is under the k-th
score the task has found; then no other group of the block can change its
list. The tasks' lists, k rows an item each, are ranked together.

Scores are 64-bit whole numbers, see ``term_weight`` and ``score_parts``.
Items are read in blocks of ``BLOCK_TERMS`` terms and each block is one ranking
of all documents, so tasks hold a bounded number of terms (an item with more
is a block of its own). A block of documents has at most ``BLOCK_CELLS`` cells.

Defined results: null texts and texts without a term are no documents and
find nothing. Scores of 0 are not listed. Equal scores go by ascending id,
null last; equal rows are listed once each. Rows of the items that repeat an
id and a text are one item; other texts under an id are items of their own,
ranked apart. Whole texts are counted, however long. Other columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_pieces, written

#: Bytes that belong to no term: ASCII but for digits and letters (fixed pattern).
_SEPARATORS = bytes(b for b in range(128) if not (chr(b).isdigit() or chr(b).isalpha()))
#: Separators become blanks, A to Z small letters; other bytes stay.
_FOLD = bytes(32 if b in _SEPARATORS else b for b in range(256)).lower()
BLOCK_TERMS = 200_000
BLOCK_CELLS = 1 << 24
BLOCK_DOCUMENTS = 4_096
#: Documents of the best groups that are evaluated at a time.
AT_ONCE = 256
_NO_ID = np.iinfo(np.int64).max


def terms_of(data: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return data.translate(_FOLD).split()


def term_weight(documents: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1)))"""
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def length_norm(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    return 50 + (50 * n * documents) // terms


def score_parts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1_000 * tf + 20 * m)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow_pieces(batches):
        found = [sorted(set(terms_of(t))) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["item"], pa.array(found, pa.list_(pa.binary()))], names=["item", "terms"])


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_terms: int = BLOCK_TERMS) -> Iterator[list]:
    """Lists of (id, terms) with at most ``block_terms`` terms together, or one item."""
    distinct = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")) \
        .filter("text IS NOT NULL").distinct().select("item", F.col("text").cast("binary").alias("text"))
    rows = written(distinct.mapInArrow(_item_terms, "item long, terms array<binary>").filter(F.size("terms") > 0),
                   "search-items")
    block: list[tuple] = []
    size = 0
    for row in rows.toLocalIterator():
        if block and size + len(row["terms"]) > block_terms:
            yield block
            block, size = [], 0
        block.append((row["item"], [bytes(t) for t in row["terms"]]))
        size += len(row["terms"])
    if block:
        yield block


def _counts(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_pieces(batches):
            lengths, terms, tfs = [], [], []
            for data in batch["text"].to_pylist():
                found = terms_of(data)
                held = [(vocabulary[t], c) for t, c in Counter(found).items() if t in vocabulary]
                lengths.append(len(found))
                terms.append([t for t, _ in held])
                tfs.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int32()))], names=["id", "n", "terms", "tfs"])
    return run


class _Best:
    """The k best (score, id) so far; equal scores by ascending id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must score to matter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        wanted = scores >= self.least
        if wanted.any():
            scores, ids = np.r_[self.scores, scores[wanted]], np.r_[self.ids, ids[wanted]]
            first = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[first], ids[first]


def _masks(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct masks as columns of ``present`` (term, document), and each document's mask."""
    bits = np.packbits(present, axis=0).T
    words = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
    words[:, : bits.shape[1]] = bits
    keys = words.view(np.uint64)
    order = np.lexsort(keys.T)
    ordered = keys[order]
    new = np.r_[True, (ordered[1:] != ordered[:-1]).any(axis=1)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return present[:, order[new]], group


class _Block:
    """Documents of a block: parts of their scores as a matrix (term, document)."""

    def __init__(self, ids, n, terms, tfs, doc, documents: int, all_terms: int):
        self.ids = ids
        self.m = length_norm(n, documents, all_terms)
        self.terms, row = np.unique(terms, return_inverse=True)
        self.parts = np.zeros((len(self.terms), len(ids)), np.int32)
        self.parts[row, doc] = score_parts(tfs, self.m[doc])
        self.best_part = self.parts.max(axis=1, initial=0).astype(np.int64)
        self.most = np.zeros(len(self.terms), np.int64)
        np.maximum.at(self.most, row, tfs)

    def rank(self, item_terms: np.ndarray, weights: np.ndarray, best: _Best) -> None:
        at = np.searchsorted(self.terms, item_terms)
        held = at < len(self.terms)
        held[held] = self.terms[at[held]] == item_terms[held]
        at, w = at[held], weights[held]
        if not len(at):
            return
        parts = self.parts[at]
        docs = np.flatnonzero(parts.any(axis=0))
        if not len(docs):
            return
        parts = parts[:, docs]
        masks, group = _masks(parts > 0)
        shortest = np.full(masks.shape[1], np.iinfo(np.int64).max)
        np.minimum.at(shortest, group, self.m[docs])
        reach = np.minimum(self.best_part[at][:, None], score_parts(self.most[at][:, None], shortest[None, :]))
        bounds = (masks * reach * w[:, None]).sum(axis=0)
        of_doc = bounds[group]
        order = np.argsort(-of_doc, kind="stable")
        order = order[of_doc[order] >= best.least]
        start = 0
        while start < len(order):
            chosen = order[start : start + AT_ONCE]
            if of_doc[chosen[0]] < best.least:
                break
            best.add(w @ parts[:, chosen].astype(np.int64), self.ids[docs[chosen]])
            start += AT_ONCE


def _blocks(batches: Iterator[pa.RecordBatch], documents: int, all_terms: int) -> Iterator[_Block]:
    for batch in batches:
        ids = batch["id"].fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        n = batch["n"].to_numpy(zero_copy_only=False)
        edges = batch["terms"].offsets.to_numpy()
        terms, tfs = (batch[c].values.to_numpy(zero_copy_only=False) for c in ("terms", "tfs"))
        start = 0
        while start < len(ids):
            # the distinct terms are at most as many as the counts
            end = min(len(ids), start + BLOCK_DOCUMENTS)
            while end > start + 1 and len(np.unique(terms[edges[start] : edges[end]])) * (end - start) > BLOCK_CELLS:
                end = start + max(1, (end - start) // 2)
            part = slice(edges[start], edges[end])
            doc = np.repeat(np.arange(end - start), np.diff(edges[start : end + 1]))
            yield _Block(ids[start:end], n[start:end], terms[part], tfs[part].astype(np.int64), doc, documents, all_terms)
            start = end


def _ranker(items: list[np.ndarray], weights: list[np.ndarray], k: int, documents: int, all_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in items]
        for block in _blocks(batches, documents, all_terms):
            for terms, w, found in zip(items, weights, best, strict=True):
                block.rank(terms, w, found)
        sizes = [len(b.ids) for b in best]
        ids = np.concatenate([b.ids for b in best]) if best else np.empty(0, np.int64)
        scores = np.concatenate([b.scores for b in best]) if best else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(best)), sizes), pa.int32()),
             pa.array(ids, pa.int64(), mask=ids == _NO_ID), pa.array(scores, pa.int64())],
            names=["item", "id", "score"])
    return run


def _rank_block(texts: DataFrame, block: list, k: int) -> DataFrame:
    spark = texts.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    counts = written(texts.mapInArrow(_counts(vocabulary), "id long, n long, terms array<int>, tfs array<int>")
                     .filter("n > 0"), "search-counts")
    seen = counts.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    if not seen["documents"]:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    held = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toPandas()
    df = np.zeros(len(vocabulary), np.int64)  # one number per term of the block of items
    df[held["term"].to_numpy()] = held["df"].to_numpy()
    weight = term_weight(seen["documents"], df)
    items = [np.array(sorted(vocabulary[t] for t in terms), np.int32) for _, terms in block]
    run = _ranker(items, [weight[i] for i in items], k, seen["documents"], seen["terms"])
    found = counts.filter(F.size("terms") > 0).select("id", "n", "terms", "tfs").mapInArrow(
        run, "item int, id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def ranked_documents(
    docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, k: int = 50, *,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every item."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")) \
        .filter(F.col("text").isNotNull())
    blocks = item_blocks(items, item_col, item_text, block_terms)
    ranked = [written(_rank_block(texts, block, k), "search-ranked") for block in blocks]
    if not ranked:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = ranked[0]
    for more in ranked[1:]:
        out = out.unionByName(more)
    return out
