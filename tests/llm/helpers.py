"""Small tables with the awkward cases every operator must stand."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def words(rng: random.Random, n: int, vocabulary: int = 300) -> str:
    made = random.Random(9)
    known = ["".join(made.choice("abcdefgh") for _ in range(made.randint(1, 6))) for _ in range(vocabulary)]
    return " ".join(rng.choice(known) for _ in range(n))


def awkward_documents() -> list[tuple]:
    """(doc_id, text): nulls, empty and long texts, copies, repeated rows and ids."""
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randint(0, 150))) for i in range(60)]
    passage = words(rng, 70)
    for i in range(60, 80):
        rows.append((i, words(rng, 40) + "\n" + passage + "\n" + words(rng, 30)))
    for i in range(80, 95):  # near copies
        text = rows[2][1].split() if i % 2 else rows[7][1].split()
        if text:
            text[rng.randrange(len(text))] = "other"
        rows.append((i, " ".join(text)))
    rows += [(95, rows[5][1]), (96, rows[5][1]), (5, rows[5][1]), (5, rows[5][1])]
    rows += [(100, None), (101, ""), (102, "a" * 1500), (103, "x y"), (104, "  \n\n "), (None, rows[3][1]),
             (None, None), (105, "été " * 4000), (106, "\x00\x01 " * 90)]
    return rows


def document_table(spark, rows):
    """The rows as documents, with columns whose names the operators use inside."""
    return (spark.createDataFrame(rows, "doc_id long, text string")
            .withColumns({"id": F.lit("theirs"), "key": F.lit(1), "n": F.lit(2), "rank": F.lit(None).cast("int"),
                          "label": F.lit("x"), "component": F.lit(3), "value": F.lit(None).cast("string"),
                          "lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
            .repartition(3))
