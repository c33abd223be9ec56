from __future__ import annotations

import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from helpers import awkward_documents, document_table
from tidemark.llm.mixing import MOST_EPOCHS, mix_sources, source_targets


def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    stopped: set = set()
    while True:
        left = sum(sizes.values()) - sum(MOST_EPOCHS * sizes[s] for s in stopped)
        open_weight = sum(w for s, w in weight.items() if s not in stopped)
        share = {s: Fraction(weight[s] * left, open_weight) for s in sizes if s not in stopped}
        more = {s for s, v in share.items() if v > MOST_EPOCHS * sizes[s]}
        if not more:
            return {s: share.get(s, Fraction(MOST_EPOCHS * sizes[s])) for s in sizes}
        stopped |= more


def rows_of(seed: int = 1):
    rng = random.Random(seed)
    sizes = {"tiny": 3, "middle": 300, "hot": 9000, None: 40, "élan": 200, "zeta": 0}
    return [(i, "w " * rng.randint(0, 30) if s != "zeta" else " \n ", s)
            for i, s in enumerate(s for s, n in sizes.items() for _ in range(max(1, n // 10)))]


def test_targets_agree_with_repeated_sharing(spark):
    rng = random.Random(5)
    for case in range(6):
        sizes = {f"s{i}": int(10 ** rng.uniform(0, 7)) for i in range(rng.randint(1, 12))}
        if case % 2:
            sizes[None] = 0
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r for r in source_targets(table).collect()}
        want = brute_targets(sizes)
        assert {s: int(v) for s, v in want.items()} == {s: r["budget"] for s, r in got.items()}
        assert all(r["target"] == pytest.approx(float(want[s])) for s, r in got.items())


@pytest.mark.parametrize("rows_per_cell", [5, 100_000])
def test_words_meet_budgets_and_reruns_agree(spark, rows_per_cell):
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")

    def mixed(parts):
        out = mix_sources(docs.repartition(parts), "doc_id", "text", "source", rows_per_cell=rows_per_cell)
        return sorted((tuple(r) for r in out.collect()), key=repr)

    got = mixed(3)
    assert got == mixed(7)
    assert [r[0] for r in sorted(got)] == [r[0] for r in rows]
    taken, sizes = defaultdict(int), defaultdict(int)
    text = {i: t for i, t, _ in rows}
    partly = defaultdict(int)
    for key, size, source, source_size, target, words in got:
        assert size == len(re.findall(r"[^\x20\x09-\x0D]+", text[key])) and 0 <= words <= MOST_EPOCHS * size
        taken[source] += words
        sizes[source] += size
        partly[source] += bool(size and words % size)
        # whole epochs come before any fraction
        assert words >= (int(target) // source_size) * size if source_size else words == 0
    want = brute_targets(dict(sizes))
    assert dict(taken) == {s: int(v) for s, v in want.items()}
    assert max(partly.values()) <= 1


def test_whole_documents_only(spark):
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string, source string")
    got = mix_sources(docs, "doc_id", "text", "source", cut_last=False).collect()
    assert all(r["size"] == 0 or r["taken"] % r["size"] == 0 for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 16 for r in got)


def test_better_documents_are_likelier(spark):
    rows = [(i, "a b c d", "x") for i in range(2000)] + [(5000 + i, "a", "y") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    quality = spark.range(0, 2000, 2).select("id", F.lit(9.0).alias("weight"))
    got = mix_sources(docs, "doc_id", "text", "source", quality).filter("source = 'x'").collect()
    first = [r for r in got if r["taken"] % 4 == 0 and r["taken"] > 0]
    assert len({r["taken"] for r in first}) in (1, 2)
    most = max(r["taken"] for r in got)
    good = sum(r["taken"] == most for r in got if r["id"] % 2 == 0)
    plain = sum(r["taken"] == most for r in got if r["id"] % 2)
    assert good > 1.3 * plain


def test_awkward_rows(spark):
    docs = document_table(spark, awkward_documents()).withColumn("source", F.lit(None).cast("string")) \
        .withColumns({"size": F.lit("s"), "__gone": F.lit(1), "mark": F.lit(2), "u": F.lit(3)})
    quality = spark.createDataFrame([(1, float("nan")), (2, None), (3, -4.0), (4, float("inf"))], "id long, weight double")
    got = mix_sources(docs, "doc_id", "text", "source", quality).collect()
    assert len(got) == docs.count()
    assert sum(r["taken"] for r in got) == sum(r["size"] for r in got) == got[0]["source_size"]
    assert mix_sources(docs.limit(0), "doc_id", "text", "source").count() == 0
