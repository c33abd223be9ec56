"""Web archives: writing records, and reading them by verified boundary chains.

Archives are uncompressed WARC/1.1 files that Spark's text writer makes: a
record is one text row, and the writer's line end is the blank line that ends
a record. Pages of equal payload are written once; the others become revisit
records that name the first.

Reading cuts the files at every occurrence of the version line, wherever a
task's part of a file begins or ends. Each piece is only a candidate: its
header, if it parses, says where the next record must begin. Pointer jumping
from the start of each file along these offsets, doubled in every round, keeps
the candidates that a chain of whole records reaches; version lines inside a
payload are not on the chain and are put back into the payload they came from.
No file and no chain is read by one task.

Defined results: a null or empty payload is a record of length 0, and such
records are equal to each other. Rows of the smallest id of a payload are all
responses, also when that id repeats. A null id revisits a payload that has an
id and is a response otherwise. A null url is left out, line breaks in a url
are escaped. A chain that ends before its file does (a damaged archive) keeps
what it reached. Other columns are ignored; empty tables make empty archives
and empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import written
from tidemark.session import new_folder

VERSION = "WARC/1.1"
BREAK = "\r\n"
#: The version line starts every record; fixed values of the format.
MAGIC = VERSION + BREAK
RECORD_END = BREAK + BREAK
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_ID = "urn:page:"
DATE = "2026-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    hexed = F.sha1(data)
    digits = []
    for i in range(8):
        part = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        digits.extend(F.substr(F.lit(BASE32), F.shiftright(part, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
                      for shift in (15, 10, 5, 0))
    return F.concat(*digits)


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))).otherwise(F.lit(""))


def archive_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str,
                    least_bytes: int = 0) -> DataFrame:
    """One text row per page: a response, or a revisit of the first page of equal payload.

    Payloads under ``least_bytes`` are always responses.
    """
    rows = pages.select(
        F.col(id_col).alias("id"), F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.encode("payload", "utf-8")),
                             "size": F.octet_length("payload").cast("long")})
    repeated = written(
        rows.filter(F.col("size") >= least_bytes).groupBy("digest", "size")
        .agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1 AND first IS NOT NULL")
        .select(F.col("digest").alias("same"), F.col("size").alias("same_size"), "first"), "warc-repeated")
    joined = rows.join(repeated, (F.col("digest") == F.col("same")) & (F.col("size") == F.col("same_size")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    identity = lambda c: F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    refers = F.when(revisit, identity(F.col("first")))
    return joined.select(F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", identity(F.col("id"))),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Refers-To", refers),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("X-Payload-Length", F.col("size").cast("string")),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit(BREAK),
        F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("value"))


def write_archives(records: DataFrame, path: str) -> None:
    """Uncompressed archives, a file per task, below ``path``."""
    records.write.option("lineSep", RECORD_END).option("compression", "none").text(path)


def _field(name: str) -> Column:
    found = F.regexp_extract("header", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """The pieces between version lines, in the order of each part of each file."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("order"))


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every piece with its offset, its parsed header and the offset its successor must have."""
    data = F.col("value").cast("binary")
    size = F.octet_length(data).cast("long")
    parsed = _segments(spark, path).withColumns(
        {"size": size, "header": F.substring_index("value", RECORD_END, 1)}).withColumns(
        {"head": F.octet_length("header").cast("long") + len(RECORD_END),
         "length": F.expr("try_cast(regexp_extract(header, '(?im)^Content-Length:[ \\t]*([0-9]+)[ \\t]*\\r?$', 1) AS bigint)")})
    whole = (F.col("head") <= F.col("size")) & (F.col("head") + F.col("length") <= F.col("size"))
    payload = F.substring(data, F.col("head").cast("int") + 1, F.col("length").cast("int"))
    rows = written(parsed.select(
        "file", "part", "order", "size",
        F.when(F.col("head") <= F.col("size"), F.col("head") + F.col("length")).alias("span"),
        "head", "length", F.coalesce(whole, F.lit(False)).alias("whole"),
        F.sha1(data).alias("piece"),
        F.when(whole, base32_sha1(payload)).alias("digest"),
        _field("WARC-Type").alias("type"), _field("WARC-Record-ID").alias("record_id"),
        _field("WARC-Refers-To").alias("refers_to"), _field("WARC-Target-URI").alias("url"),
        _field("WARC-Payload-Digest").alias("named_digest"), _field("X-Payload-Length").alias("named_length"),
    ), "warc-pieces")
    step = F.col("size") + len(MAGIC)
    parts = rows.groupBy("file", "part").agg(F.sum(step).alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(parts.select("file", "part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base")),
                    "warc-parts")
    inside = Window.partitionBy("file", "part").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum(step).over(inside), F.lit(0))).join(parts, ["file", "part"])
    # offset of the version line in front of the piece; what stands before the first one has -len(MAGIC)
    start = F.col("base") + F.col("before") - len(MAGIC)
    return placed.withColumn("start", start).withColumn(
        "next", F.col("start") + len(MAGIC) + F.col("span") + len(RECORD_END)).drop("base", "before", "span")


def _dealt(rows: DataFrame) -> DataFrame:
    """For joins with a row per record: never broadcast.

    Stored, a path and an offset take a byte or a few, far from what they take on the
    driver, so a file below the bound of a broadcast can hold millions of them.
    """
    return rows.hint("merge")


def _reachable(candidates: DataFrame) -> DataFrame:
    """``file, start`` of the candidates on the chain from offset 0 of their file.

    Rounds are stored as files, whose sizes the next plan knows. A checkpoint keeps the
    estimate of its plan, and the joins of a round multiply it by itself twice: a number
    of three times the digits in every round, on the driver.
    """
    state = written(candidates.filter("start >= 0").select(
        "file", "start", F.col("next").alias("to"), (F.col("start") == 0).alias("real")), "warc-chain")
    longest = state.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(1, longest.bit_length())):
        # after k rounds ``to`` is 2^k records ahead, and so many from the start are real
        ahead = state.filter(F.col("real") & F.col("to").isNotNull()).select(
            "file", F.col("to").alias("start"), F.lit(True).alias("hit"))
        hop = state.select("file", F.col("start").alias("to"), F.col("to").alias("further"))
        state = written(
            state.join(_dealt(ahead), ["file", "start"], "left").join(_dealt(hop), ["file", "to"], "left").select(
                "file", "start", F.col("further").alias("to"),
                (F.col("real") | F.coalesce("hit", F.lit(False))).alias("real")), "warc-chain")
    return state.filter("real").select("file", "start")


def _marked(candidates: DataFrame) -> DataFrame:
    """The candidates from the first version line on; ``real`` is true on the chain and null beside it."""
    reached = written(_reachable(candidates), "warc-reached").withColumn("real", F.lit(True))
    return candidates.join(_dealt(reached), ["file", "start"], "left").filter("start >= 0")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, type, url, refers_to, length, digest`` of every whole record; digests are of the bytes read.

    Revisit records have the length and digest of the payload they refer to,
    or those they name if it is not in these archives.
    """
    candidates = written(_candidates(spark, path), "warc-candidates")
    kept = _marked(candidates)
    records = written(kept.filter("real"), "warc-records")
    cut = records.filter(~F.col("whole")).select("file", F.col("start").alias("owner"), "next", "length",
                                                 F.col("head").alias("owner_head"))
    # pieces of a payload that holds version lines: all that start inside its record
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    broken = written(cut, "warc-cut")
    owned = kept.join(broken.select("file").distinct(), "file", "left_semi").select(
        "file", "start", "piece", F.last(F.when(F.col("real"), F.col("start")), ignorenulls=True).over(order).alias("owner"))
    needed = written(owned.join(_dealt(broken), ["file", "owner"]).select("file", "start", "piece", "owner", "length", "owner_head"),
                     "warc-needed")
    names = needed.select("file", "piece").distinct()
    texts = (_segments(spark, path).select("file", F.col("value").cast("binary").alias("bytes"))
             .withColumn("piece", F.sha1("bytes")).join(names, ["file", "piece"], "left_semi")
             .dropDuplicates(["file", "piece"]))
    hexed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", F.hex("bytes").alias("h")))),
                                     lambda s: s["h"]), MAGIC.encode().hex().upper())
    joined = needed.join(texts, ["file", "piece"]).groupBy("file", "owner").agg(
        hexed.alias("hexed"), F.first("length").alias("length"), F.first("owner_head").alias("head"))
    mended = joined.select("file", F.col("owner").alias("start"), base32_sha1(F.unhex(F.substring(
        "hexed", 2 * F.col("head").cast("int") + 1, 2 * F.col("length").cast("int")))).alias("mended"))
    whole = written(
        records.join(mended, ["file", "start"], "left")
        .select("record_id", "type", "url", "refers_to", "length", F.coalesce("digest", "mended").alias("digest"),
                F.regexp_replace("named_digest", "^sha1:", "").alias("named_digest"),
                F.col("named_length").cast("long").alias("named_length")), "warc-whole")
    origin = written(
        whole.filter("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("length").alias("o_length"),
                                                 F.col("digest").alias("o_digest"))
        .join(whole.filter("type = 'revisit'").select("refers_to").distinct(), "refers_to", "left_semi")
        .dropDuplicates(["refers_to"]), "warc-origins")
    revisit = F.col("type") == "revisit"
    return whole.join(origin, "refers_to", "left").select(
        "record_id", "type", "url", "refers_to",
        F.when(revisit, F.coalesce("o_length", "named_length")).otherwise(F.col("length")).alias("length"),
        F.when(revisit, F.coalesce("o_digest", "named_digest")).otherwise(F.col("digest")).alias("digest"))


def archive_round_trip(pages: DataFrame, id_col: str, url_col: str, payload_col: str,
                       least_bytes: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder and read these back."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archives(archive_records(pages, id_col, url_col, payload_col, least_bytes), path)
    return read_archives(spark, path)


def page_of(record_id: Column) -> Column:
    """The page id inside a record id."""
    named = F.regexp_extract(record_id, f"^<{RECORD_ID}(.*)>$", 1)
    return F.when(named != "", named)
