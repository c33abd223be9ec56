from __future__ import annotations

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc
from tidemark.session import new_folder

M = warc.MAGIC
ROWS = [
    (1, "a"), (2, "b" + M + "x"), (3, "a"), (4, None), (5, ""), (6, M), (7, M + M + M),
    (8, M + "Content-Length: 3\r\n\r\nabc\r\n\r\n" + M + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"),
    (9, "é" * 3000 + M + "ü" * 50), (10, "é" * 3000 + M + "ü" * 50), (11, "\r\n\r\n"), (12, "x\r\n\r\n" + M),
    (None, "a"), (None, "zz"), (13, "WARC/1."), (14, "1\r\n"), (15, "q" * 200_000), (7, M + M + M),
    (16, "\r\n\r\n" + M + "Content-Length: 99999999999999999999\r\n\r\n"),
    *[(100 + i, f"p{i % 7}" * (i * 13 % 401)) for i in range(80)],
    *[(900 + i, ("<p>" + M) * i) for i in range(12)],
]


def expected(rows):
    first: dict = {}
    for i, text in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        revisit = (text or "") in first and first[text or ""] != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "revisit" if revisit else "response", first[text or ""] if revisit else None))
    return sorted(out, key=repr)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, html string").withColumns(
        {"url": F.when(F.col("page_id") % 2 == 0, F.lit("http://a\r\nb/ü")), "value": F.lit(1), "digest": F.lit("x"),
         "first": F.lit(2), "same": F.lit("y")})


def read(df):
    rows = df.select(warc.page_of(F.col("record_id")).cast("long"), "length", "digest", "type",
                     warc.page_of(F.col("refers_to")).cast("long")).collect()
    return sorted([tuple(r) for r in rows], key=repr)


@pytest.mark.parametrize("split", ["3k", "128m"])
def test_round_trip_with_version_lines_in_payloads(spark, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = read(warc.archive_round_trip(pages(spark, ROWS).repartition(3), "page_id", "url", "html"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == expected(ROWS)


def test_least_bytes_and_empty(spark):
    df = pages(spark, [(1, "abc"), (2, "abc"), (3, "a"), (4, "a")])
    kinds = {r[0]: r[3] for r in read(warc.archive_round_trip(df, "page_id", "url", "html", 2))}
    assert kinds == {1: "response", 2: "revisit", 3: "response", 4: "response"}
    assert read(warc.archive_round_trip(df.limit(0), "page_id", "url", "html")) == []


def test_damaged_archive_keeps_what_the_chain_reaches(spark):
    path = new_folder(spark, "damaged")
    good = "WARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    bad = "WARC-Type: response\r\nWARC-Record-ID: <urn:page:2>\r\nContent-Length: 50\r\n\r\nhi\r\n\r\n"
    lost = good.replace("page:1", "page:3")
    spark.createDataFrame([(M + good + M + bad + M + lost,)], "value string").coalesce(1) \
        .write.option("lineSep", "\n").text(path)
    ids = [r[0] for r in read(warc.read_archives(spark, path))]
    assert 1 in ids and 3 not in ids


def one_archive(spark, records):
    """An archive of so many records in one file, and its candidates."""
    df = spark.range(records).selectExpr("id AS page_id", "'http://a' AS url", "concat('page ', id) AS html").coalesce(1)
    path = new_folder(spark, "chain")
    warc.write_archives(warc.archive_records(df, "page_id", "url", "html"), path)
    return warc._candidates(spark, path)


def test_rounds_of_a_long_chain_do_not_grow_the_estimates(spark):
    found = warc._reachable(one_archive(spark, 3000))
    assert found.count() == 3000
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**40


def test_tables_with_a_row_per_record_are_not_broadcast(spark):
    marked = warc._marked(warc.written(one_archive(spark, 100), "pieces"))
    assert "Broadcast" not in marked._jdf.queryExecution().executedPlan().toString()
    assert marked.filter("real").count() == 100
