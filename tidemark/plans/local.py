"""Small driver-side results as tables."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MAX_ROWS = 200_000


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """Table of a few rows that is part of the plan itself, so reading it takes no task.

    For class counts, cut points and the like; what has grown beyond that is dealt
    out to tasks instead.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)
    columns = [
        pa.array([_plain(r[i], f.dataType) for r in rows], type=arrow.field(i).type)
        for i, f in enumerate(kind.fields)
    ]
    table = spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema=kind)
    return table if len(rows) <= MAX_ROWS else table.repartition(-(-len(rows) // MAX_ROWS))


def _plain(value, kind: T.DataType):
    """Tuples of a struct as the mapping Arrow expects; maps as pairs."""
    if isinstance(kind, T.StructType) and isinstance(value, tuple):
        return {f.name: _plain(v, f.dataType) for f, v in zip(kind.fields, value)}
    if isinstance(kind, T.MapType) and isinstance(value, dict):
        return list(value.items())
    return value
