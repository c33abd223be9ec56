"""Request bodies as variants: envelope rules and record rules of whole requests.

A body is parsed once into a variant. Requests without records and envelopes
with unknown keys stay rows, and a request is accepted as a whole or not at
all. Everything happens inside the row: no request is taken apart and grouped
again, however many records it has.

Defined results: a null body, a body that is no JSON, is no object or repeats a
key has the error ``body:json`` and no records. Records that are no objects have
the error ``record:object``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import NUMBER_PATTERN, col, constant, strip
from tidemark.operators.contract import MAX_REQUEST_RECORDS, RecordRule

RECORDS_KEY = "instances"


def _path(name: str) -> str:
    if "'" in name or "\\" in name:
        raise ValueError(f"field '{name}' cannot be part of a path")
    return f"$['{name}']"


def _broken(record: Column, rules: Sequence[RecordRule]) -> Column:
    """``field:kind`` of every rule a record breaks, then its unknown fields."""
    fields = F.try_variant_get(record, "$", "map<string,variant>")

    def of(rule: RecordRule) -> Column:
        text = strip(F.try_variant_get(record, _path(rule.field), "string"))
        number = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
        return F.when(~rule.accepts(text, number), F.lit(f"{rule.field}:{rule.kind}"))

    unknown = F.array_sort(F.array_except(F.map_keys(fields), constant([r.field for r in rules], "string")))
    found = F.concat(
        F.array_compact(F.array(*[of(r) for r in rules])), F.transform(unknown, lambda n: F.concat(n, F.lit(":extra")))
    )
    return F.when(fields.isNull(), F.array(F.lit("record:object"))).otherwise(found)


def check_requests(
    df: DataFrame,
    body: str,
    rules: Sequence[RecordRule],
    maximum: int = MAX_REQUEST_RECORDS,
    records_key: str = RECORDS_KEY,
) -> DataFrame:
    """Add ``record_count``, ``errors`` and ``accepted``; every request stays a row.

    Errors of the envelope come first (``body:json``, ``<key>:missing``,
    ``<key>:array``, ``<key>:too_short``, ``<key>:too_long``, ``<other>:extra``),
    then ``<key>.<position>.<field>:<kind>`` of the records by position.
    """
    parsed = df.withColumn("__body", F.try_parse_json(col(body)))
    opened = parsed.withColumns({
        "__keys": F.map_keys(F.try_variant_get("__body", "$", "map<string,variant>")),
        "__records": F.try_variant_get("__body", _path(records_key), "array<variant>"),
    })
    keys, records = F.col("__keys"), F.col("__records")
    size = F.size(records)
    extra = F.array_sort(F.array_except(keys, F.array(F.lit(records_key))))
    of_list = (
        F.when(~F.array_contains(keys, records_key), "missing").when(records.isNull(), "array")
        .when(size < 1, "too_short").when(size > maximum, "too_long")
    )
    envelope = F.concat(
        F.array_compact(F.array(F.concat(F.lit(f"{records_key}:"), of_list))),
        F.transform(extra, lambda n: F.concat(n, F.lit(":extra"))),
    )
    of_records = F.flatten(F.transform(records, lambda record, i: F.transform(
        _broken(record, rules), lambda error: F.concat(F.lit(f"{records_key}."), i.cast("string"), F.lit("."), error))))
    none = F.array().cast("array<string>")
    errors = F.when(keys.isNull(), F.array(F.lit("body:json"))).otherwise(
        F.concat(envelope, F.coalesce(of_records, none)))
    checked = opened.withColumns({
        "record_count": F.coalesce(F.when(records.isNotNull(), size), F.lit(0)), "errors": errors,
    })
    return checked.withColumn("accepted", F.size("errors") == 0).drop("__body", "__keys", "__records")


def request_records(
    df: DataFrame, body: str, fields: Sequence[str], records_key: str = RECORDS_KEY
) -> DataFrame:
    """One row per record of a request: the other columns, ``record_pos``, ``record``, and its fields as text."""
    kept = [c for c in df.columns if c != body]
    records = F.try_variant_get(F.try_parse_json(col(body)), _path(records_key), "array<variant>")
    rows = df.select(*[col(c) for c in kept], F.posexplode(records).alias("record_pos", "__record"))
    return rows.select(
        *[col(c) for c in kept], "record_pos", F.to_json("__record").alias("record"),
        *[F.try_variant_get("__record", _path(f), "string").alias(f) for f in fields],
    )
