"""Delimited files: header normalization, missing tokens, type inference."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import (
    DEFAULT_NA_TOKENS,
    INTEGER_PATTERN,
    NUMBER_PATTERN,
    blank_to_null,
    col,
    strip,
    to_number,
)
from tidemark.operators.contract import ContractError, contract_report
from tidemark.options import DatasetOptions
from tidemark.plans.local import small_table

# --- fixed values -----------------------------------------------------------
BYTE_ORDER_MARK = "\ufeff"
TRUE_WORDS = ("True", "TRUE", "true")
FALSE_WORDS = ("False", "FALSE", "false")
# ----------------------------------------------------------------------------

# a quoted empty field is a value here, so that one too many is seen; Spark reads an unquoted one as null
CSV_SETTINGS = {"quote": '"', "escape": '"', "encoding": "UTF-8", "nullValue": "\x00", "mode": "PERMISSIVE"}
OVERFLOW = "__overflow"
#: Files whose first line is read at the same time.
HEADERS_AT_ONCE = 32


def normalize_header(names: Sequence[str], renames: Mapping[str, str]) -> list[str]:
    """Names without byte order mark and outer blanks, then renamed."""
    clean = [str(n).replace(BYTE_ORDER_MARK, "").strip() for n in names]
    return [renames.get(n, n) for n in clean]


def _first_line(spark: SparkSession, file: str) -> str | None:
    """The first line of a file that is not blank; only the bytes up to its end are read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        plain = codec.createInputStream(stream) if codec else stream
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, CSV_SETTINGS["encoding"]))
        line = lines.readLine()
        while line is not None and not line.replace(BYTE_ORDER_MARK, "").strip():
            line = lines.readLine()
        return line
    finally:
        stream.close()


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files by their header line; the names are as written. No data are read."""
    files = sorted(spark.read.text(path).inputFiles())  # the list that every scan of them has
    with ThreadPool(HEADERS_AT_ONCE) as pool:
        lines = pool.map(lambda file: _first_line(spark, file), files)
    found: dict[tuple[str, ...], list[str]] = {}
    for file, line in zip(files, lines, strict=True):
        if line is not None:
            names = next(csv.reader([line.replace(BYTE_ORDER_MARK, "")]))
            # the list is of addresses, readers take names
            name = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file)).toString()
            found.setdefault(tuple(names), []).append(name)
    return found


def _checked_names(names: Sequence[str], renames: Mapping[str, str]) -> list[str]:
    clean = normalize_header(names, renames)
    repeated = sorted({n for n in clean if clean.count(n) > 1})
    if repeated:
        raise ContractError(f"column names repeat after normalization: {', '.join(repeated)}")
    return clean


def _text_rows(spark: SparkSession, path: str, options: DatasetOptions, multiline: bool) -> DataFrame:
    """All files under the names of their own headers, with what exceeds the header in ``OVERFLOW``."""
    settings = {**CSV_SETTINGS, "multiLine": str(multiline).lower(), "header": "true"}
    try:
        headers = _headers(spark, path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"dataset not found: {path}") from error
        raise
    if not headers:
        raise ContractError("the dataset is empty")
    tables, columns = [], None
    for written, files in headers.items():
        names = _checked_names(written, options.renames)
        columns = columns or names
        if sorted(names) != sorted(columns):
            raise ContractError(f"'{files[0]}' has other columns than the files before it")
        # read by position, so the header as written plays no part
        fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 1)]
        rows = spark.read.options(**settings).schema(T.StructType(fields))
        tables.append(rows.csv(path if len(headers) == 1 else files).toDF(*names, OVERFLOW))
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole


def _too_many_fields(names: int) -> ContractError:
    return ContractError(f"a row has more than {names} fields")


def oversized_rows(
    spark: SparkSession, path: str, options: DatasetOptions, multiline: bool = True
) -> DataFrame:
    """Rows that have more fields than their header has names."""
    return _text_rows(spark, path, options, multiline).filter(F.col(OVERFLOW).isNotNull()).drop(OVERFLOW)


def read_text_table(
    spark: SparkSession, path: str, options: DatasetOptions, multiline: bool = True
) -> DataFrame:
    """Every column as text with missing tokens as null.

    Each file is read under its own header; files may order their columns
    differently. A row with more fields than names is an error. Line breaks in
    quotes are part of a value; ``multiline=False`` is for files known to have
    none, and lets tasks share a file.
    """
    rows = _text_rows(spark, path, options, multiline)
    if rows.filter(F.col(OVERFLOW).isNotNull()).limit(1).count():
        raise _too_many_fields(len(rows.columns) - 1)
    return mark_missing(rows.drop(OVERFLOW), options)


def mark_missing(df: DataFrame, options: DatasetOptions, keep: Sequence[str] = ()) -> DataFrame:
    """Missing tokens as null in the text columns that are not in ``keep``."""
    tokens = tuple(dict.fromkeys((*DEFAULT_NA_TOKENS, *options.na_values)))
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keep]
    return df.withColumns({n: blank_to_null(n, tokens) for n in text}) if text else df


def inferred_types(df: DataFrame) -> DataFrame:
    """``(column, inferred_type)`` for text columns, all of them in one aggregation.

    The first of bigint, double and boolean that reads every value wins;
    a column without values is double.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cells = [F.struct(F.lit(i).alias("pos"), col(n).alias("value")) for i, n in enumerate(names)]
    # columns become rows, so one small test is compiled instead of one per column
    read = (
        df.select(F.inline(F.array(*cells)))
        .filter(F.col("value").isNotNull())
        .select("pos", "value", F.inline(F.array(F.struct(strip("value").alias("text")))))
    )
    text = F.col("text")
    whole = text.rlike(INTEGER_PATTERN) & text.try_cast("bigint").isNotNull()
    tested = read.groupBy("pos").agg(
        F.bool_and(whole).alias("whole"),
        F.bool_and(text.rlike(NUMBER_PATTERN)).alias("number"),
        F.bool_and(F.col("value").isin(*TRUE_WORDS, *FALSE_WORDS)).alias("truth"),
    )
    kind = F.when(F.col("whole"), "bigint").when(F.col("number"), "double").when(
        F.col("truth"), "boolean"
    )
    columns = small_table(df.sparkSession, list(enumerate(names)), "pos int, column string")
    found = columns.join(tested, "pos", "left")
    return found.select(
        "column",
        F.when(F.col("whole").isNull(), "double").otherwise(F.coalesce(kind, F.lit("string")))
        .alias("inferred_type"),
    )


def apply_types(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    readers = {
        "bigint": lambda n: strip(n).cast("bigint"),
        "double": to_number,
        "boolean": lambda n: F.when(col(n).isNotNull(), col(n).isin(*TRUE_WORDS)),
    }
    return df.withColumns({n: readers[k](n) for n, k in kinds.items() if k in readers})


def read_dataset(
    spark: SparkSession, path: str, options: DatasetOptions, multiline: bool = True
) -> DataFrame:
    """Delimited file with normalized names, missing tokens as null and inferred types.

    One scan tests the types and whether a row has too many fields; the scan
    that uses the rows is the second.
    """
    rows = _text_rows(spark, path, options, multiline)
    text = mark_missing(rows.drop(OVERFLOW), options)
    beyond = F.when(F.col(OVERFLOW).isNotNull(), F.lit("beyond")).alias(OVERFLOW)
    tested = mark_missing(rows, options, keep=(OVERFLOW,)).select(*[col(c) for c in text.columns], beyond)
    kinds = {r["column"]: r["inferred_type"] for r in inferred_types(tested).collect()}
    if kinds.pop(OVERFLOW) == "string":  # a column without values is double
        raise _too_many_fields(len(text.columns))
    return apply_types(text, kinds)


def read_parquet_dataset(spark: SparkSession, path: str, options: DatasetOptions) -> DataFrame:
    """Typed source under the same contract: names normalized, tokens in text columns nulled."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"dataset not found: {path}") from error
        raise
    return mark_missing(df.toDF(*normalize_header(df.columns, options.renames)), options)


def load_dataset(
    spark: SparkSession, path: str, options: DatasetOptions, kind: str = "csv"
) -> tuple[DataFrame, DataFrame]:
    """Read and check: the dataset and its contract report."""
    reader = read_dataset if kind == "csv" else read_parquet_dataset
    df = reader(spark, path, options)
    return df, contract_report(df, options)
