"""Column expressions: coercion, normalization, keys, ids and small lookups.

Everything here is built from native expressions, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
MISSING = "__missing__"
OTHER = "__other__"
ALL_VALUES = "all_values"
# Numbers as a lenient tabular parser reads them: sign, decimals, exponent, infinity.
NUMBER_PATTERN = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$"
INTEGER_PATTERN = r"^[+-]?\d+$"
# Every character that counts as white space in Unicode text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Tokens read as missing in delimited files, besides those a contract adds.
DEFAULT_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
KEY_ALPHABET = r"[^A-Za-z0-9_.-]+"
DEFAULT_MONITOR_KEY = "drift_monitor"
STAMP_FORMAT = "yyyyMMdd'T'HHmmssSSSSSS'Z'"
UNMATCHED_ROUTE = "/unmatched"
METRICS_ROUTE = "/metrics"
# ----------------------------------------------------------------------------


def col(c: str | Column) -> Column:
    """Column by exact name (dots and spaces allowed), or the column itself."""
    return F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c


def constant(values: Sequence, kind: str) -> Column:
    """Array constant, written as one document; the optimizer folds it into a literal."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>")


def strip(c: str | Column) -> Column:
    """Remove all leading and trailing white space, not only spaces."""
    return F.btrim(col(c).cast("string"), F.lit(WHITE_SPACE))


def blank_to_null(c: str | Column, tokens: Sequence[str]) -> Column:
    return F.when(~col(c).isin(*tokens), col(c)) if tokens else col(c)


def finite_or_null(c: str | Column) -> Column:
    """Double with NaN read as missing."""
    value = col(c).cast("double")
    return F.when(~F.isnan(value), value)


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or not a number in a floating column."""
    value = col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def numeric_sql(name: str, kind: T.DataType) -> str:
    """The reading of ``to_number`` / ``finite_or_null`` as SQL text, for saved pipelines."""
    quoted = "`" + name.replace("`", "``") + "`"
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return f"nanvl(CAST({quoted} AS DOUBLE), CAST(NULL AS DOUBLE))"
    blanks = "".join(f"\\u{ord(c):04x}" for c in WHITE_SPACE)
    pattern = NUMBER_PATTERN.replace("\\", "\\\\")
    text = f"btrim(CAST({quoted} AS STRING), '{blanks}')"
    return f"CASE WHEN {text} RLIKE '{pattern}' THEN try_cast({text} AS DOUBLE) END"


def to_number(c: str | Column) -> Column:
    """Lenient number: anything that is not a whole numeric text becomes null."""
    text = strip(c)
    # the cast alone would also take type suffixes such as 12d
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def normalize_category(c: str | Column) -> Column:
    """Trimmed string, with null and blank mapped to the missing bucket."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(MISSING))


def sanitize_key(c: str | Column, fallback: str = DEFAULT_MONITOR_KEY) -> Column:
    """Storage-safe key: other characters become ``_``, dots and bars are cut at the ends."""
    safe = F.regexp_replace(col(c).cast("string"), KEY_ALPHABET, "_")
    return F.coalesce(
        F.nullif(F.regexp_replace(safe, r"^[._]+|[._]+$", ""), F.lit("")), F.lit(fallback)
    )


def monitor_key(
    run_id: str | Column,
    model_name: str | Column,
    model_version: str | Column,
    source_type: str | Column,
    source_uri: str | Column,
) -> Column:
    """Key of the monitored model: its run, else its registry version, else its location."""
    empty = F.lit("")
    run = F.nullif(col(run_id).cast("string"), empty)
    name = F.nullif(col(model_name).cast("string"), empty)
    version = F.nullif(col(model_version).cast("string"), empty)
    return sanitize_key(
        F.coalesce(
            F.concat(F.lit("run_"), run),
            F.concat(F.lit("registry_"), name, F.lit("_v"), version),
            F.concat_ws("_", col(source_type), F.substring(F.sha1(col(source_uri)), 1, 12)),
        )
    )


def run_id_of_uri(c: str | Column) -> Column:
    """Run id of a ``runs:/<id>/...`` location, else null."""
    return F.nullif(F.regexp_extract(col(c), r"^runs:/([^/]*)", 1), F.lit(""))


def stamp(ts: str | Column) -> Column:
    """Sortable microsecond id of a timestamp."""
    return F.date_format(col(ts), STAMP_FORMAT)


def event_id(ts: str | Column, status: str | Column) -> Column:
    return F.concat_ws("_", stamp(ts), col(status))


def status_family(code: str | Column) -> Column:
    c = col(code)
    return (
        F.when((c >= 400) & (c < 500), "client_error")
        .when(c >= 500, "server_error")
        .otherwise("success")
    )


def route_label(c: str | Column) -> Column:
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(UNMATCHED_ROUTE))


def method_label(c: str | Column) -> Column:
    return F.upper(col(c))


def feature_list(recorded: str | Column, configured: Sequence[str]) -> Column:
    """Recorded feature list when it has entries, else the configured one."""
    fallback = F.array(*[F.lit(name) for name in configured]).cast("array<string>")
    return F.when(F.coalesce(F.size(col(recorded)), F.lit(0)) > 0, col(recorded)).otherwise(fallback)


def negative_label(classes: str | Column, positive: str) -> Column:
    """First class, in key order, that is not the positive one."""
    others = F.filter(col(classes), lambda name: name != F.lit(positive))
    return F.when(F.size(others) > 0, F.array_min(others))
