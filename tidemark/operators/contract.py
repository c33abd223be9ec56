"""Contract checks on whole tables and on single records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import NUMBER_PATTERN, col, is_missing, strip
from tidemark.options import DatasetOptions
from tidemark.plans.local import small_table

# --- fixed values -----------------------------------------------------------
MAX_REQUEST_RECORDS = 1000
# ----------------------------------------------------------------------------

REPORT_SCHEMA = T.StructType(
    [
        T.StructField("row_count", T.LongType()),
        T.StructField("column_count", T.IntegerType()),
        T.StructField("validated_columns", T.ArrayType(T.StringType())),
        T.StructField("class_count", T.LongType()),
    ]
)


class ContractError(ValueError):
    """The table breaks its column contract."""


def column_presence(df: DataFrame, options: DatasetOptions) -> DataFrame:
    """One row per contracted column: whether the table has it, and in how many rows
    it has a value. The values of all columns are counted in one pass."""
    listed = {"data.target_column": (options.target,), **options.sections()}
    cells = []
    for section, names in listed.items():
        for name in names:
            present = name in df.columns
            cells.append(
                F.struct(
                    F.lit(section).alias("section"),
                    F.lit(name).alias("column"),
                    F.lit(present).alias("present"),
                    (F.count(col(name)) if present else F.count(F.lit(None))).alias("value_count"),
                )
            )
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def check_columns(columns: Sequence[str], options: DatasetOptions) -> None:
    repeated = sorted({c for c in columns if list(columns).count(c) > 1})
    if repeated:
        raise ContractError(f"column names repeat after normalization: {', '.join(repeated)}")
    if options.target not in columns:
        raise ContractError(
            f"Target column '{options.target}' is not in the table, which has: {', '.join(columns)}"
        )
    for section, names in options.sections().items():
        absent = sorted(set(names) - set(columns))
        if absent:
            raise ContractError(f"columns listed in '{section}' are absent: {', '.join(absent)}")


def target_distribution(df: DataFrame, options: DatasetOptions) -> DataFrame:
    """Rows per class, nulls as a class of their own."""
    target = F.when(~is_missing(df, options.target), col(options.target).cast("string"))
    return (
        df.groupBy(target.alias("label"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def contract_report(df: DataFrame, options: DatasetOptions) -> DataFrame:
    """Check the table and summarize it in one row; a broken contract raises.

    Rows per class are ``target_distribution``, a table however many classes
    there are; the totals come from one aggregation of it.
    """
    check_columns(df.columns, options)
    seen = target_distribution(df, options).agg(
        F.count("label").alias("classes"),
        F.count_if(F.col("label").isNull()).alias("missing"),
        F.sum("row_count").alias("rows"),
    ).first()
    if seen["missing"]:
        raise ContractError("the target column has missing values")
    if not seen["classes"]:
        raise ContractError("the table has no rows")
    if seen["classes"] < 2:
        raise ContractError("the target column needs at least two classes")
    row = (seen["rows"], len(df.columns), sorted(df.columns), seen["classes"])
    return small_table(df.sparkSession, [row], REPORT_SCHEMA)


def contract_violations(df: DataFrame, options: DatasetOptions) -> DataFrame:
    """``section, rule, detail`` of everything that breaks the contract, instead of an error."""
    found: list[tuple[str, str, str]] = []
    repeated = sorted({c for c in df.columns if df.columns.count(c) > 1})
    found += [("columns", "repeated", c) for c in repeated]
    if options.target not in df.columns:
        found.append(("data.target_column", "absent", options.target))
    for section, names in options.sections().items():
        found += [(section, "absent", c) for c in sorted(set(names) - set(df.columns))]
    listed = small_table(df.sparkSession, found, "section string, rule string, detail string")
    if options.target not in df.columns or repeated:
        return listed
    seen = target_distribution(df, options).agg(
        F.count("label").alias("classes"),
        F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("row_count"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"),
    )
    def broken(rule: str, when: Column, detail: str | Column) -> Column:
        text = F.lit(detail) if isinstance(detail, str) else detail.cast("string")
        return F.when(when, F.struct(F.lit(rule).alias("rule"), text.alias("detail")))

    rules = [
        broken("empty", F.col("rows") == 0, "0"),
        broken("missing_target", F.col("missing") > 0, F.col("missing")),
        broken("two_classes", (F.col("rows") > 0) & (F.col("classes") < 2), F.col("classes")),
    ]
    of_target = seen.select(F.inline(F.array_compact(F.array(*rules)))).select(
        F.lit("data.target_column").alias("section"), "rule", "detail"
    )
    return listed.unionByName(of_target)


@dataclass(frozen=True)
class RecordRule:
    """Rule of one record field: ``text``, ``choice``, ``integer`` or ``number``."""

    field: str
    kind: str
    choices: tuple[str, ...] = ()
    minimum: float | None = None
    optional: bool = False

    def accepts(self, text: Column, number: Column) -> Column:
        """Whether the trimmed text and its numeric reading satisfy the rule."""
        if self.kind == "text":
            ok = text != ""
        elif self.kind == "choice":
            ok = text.isin(*self.choices)
        elif self.kind in ("integer", "number"):
            ok = number.isNotNull()
            if self.kind == "integer":
                ok = ok & (number == F.floor(number))
            if self.minimum is not None:
                ok = ok & (number >= F.lit(float(self.minimum)))
        else:
            raise ValueError(f"unknown rule kind '{self.kind}'")
        absent = text.isNull() | (text == "")
        ok = F.coalesce(ok, F.lit(False))
        return (absent | ok) if self.optional else (~absent & ok)


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    if not columns:
        return df
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def check_records(
    df: DataFrame, rules: Sequence[RecordRule], payload: str | None = None
) -> DataFrame:
    """Add ``errors``: one ``field:kind`` entry per broken rule, in rule order.

    ``payload`` names a JSON object column whose unknown fields are refused too.
    """
    texts = {f"__text{i}": strip(r.field) for i, r in enumerate(rules)}
    numbers = {
        f"__number{i}": F.when(F.col(f"__text{i}").rlike(NUMBER_PATTERN),
                               F.col(f"__text{i}").try_cast("double"))
        for i, r in enumerate(rules)
        if r.kind in ("integer", "number")
    }
    # generated columns are computed once; filters on them do not repeat the parsing
    read = _once(_once(df, texts), numbers)
    none = F.lit(None).cast("double")
    broken = [
        F.when(
            ~r.accepts(
                F.col(f"__text{i}"), F.col(f"__number{i}") if f"__number{i}" in numbers else none
            ),
            F.lit(f"{r.field}:{r.kind}"),
        )
        for i, r in enumerate(rules)
    ]
    errors = F.array_compact(F.array(*broken))
    if payload is not None:
        known = F.array(*[F.lit(r.field) for r in rules])
        unknown = F.array_sort(F.array_except(F.json_object_keys(col(payload)), known))
        extra = F.transform(unknown, lambda name: F.concat(name, F.lit(":extra")))
        errors = F.concat(errors, F.coalesce(extra, F.array().cast("array<string>")))
    return _once(read, {"errors": errors}).drop(*texts, *numbers)


def valid_records(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") == 0).drop("errors")


def rejected_records(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") > 0)


def request_sizes(
    df: DataFrame, request: str, maximum: int = MAX_REQUEST_RECORDS
) -> DataFrame:
    """Records per request and whether the request is within its size bounds."""
    return (
        df.groupBy(col(request))
        .agg(F.count(F.lit(1)).alias("record_count"))
        .withColumn("accepted", F.col("record_count").between(1, maximum))
    )


def churn_record_rules() -> list[RecordRule]:
    """Rules of the customer record served by the churn model."""
    # --- fixed values -------------------------------------------------------
    text_fields = (
        "gender", "Partner", "Dependents", "PhoneService", "MultipleLines", "InternetService",
        "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
        "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
    )
    # ------------------------------------------------------------------------
    return [
        *[RecordRule(name, "text") for name in text_fields],
        RecordRule("SeniorCitizen", "choice", choices=("0", "1")),
        RecordRule("tenure", "integer", minimum=0),
        RecordRule("MonthlyCharges", "number", minimum=0),
        RecordRule("TotalCharges", "number", minimum=0, optional=True),
    ]
