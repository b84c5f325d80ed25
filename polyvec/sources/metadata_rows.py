"""Metadata rows from JSON: types by the first value of each column, columns by all rows."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def column_type(value) -> T.DataType:
    if isinstance(value, bool) or isinstance(value, int):
        return T.LongType()
    return T.DoubleType() if isinstance(value, float) else T.StringType()


def schema_of(rows: Sequence[dict]) -> T.StructType:
    """doc_id and every key: whole numbers and truth values as long, numbers as double, all else as text."""
    first: dict = {}
    for row in rows:
        for key, value in row.items():
            if not _NAME.match(key):
                raise ValueError(f"{key!r} is no column name")
            if first.get(key) is None:
                first[key] = value
    return T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(k, column_type(v)) for k, v in first.items()]])


def _cell(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value) if isinstance(value, (dict, list)) else str(value)
    try:
        return int(value) if isinstance(kind, T.LongType) else float(value)
    except (TypeError, ValueError):
        return None


def from_rows(spark: SparkSession, rows: Sequence[dict], first_id: int = 0) -> DataFrame:
    """A metadata table of JSON objects, numbered from first_id; missing keys are null."""
    schema = schema_of(rows)
    return spark.createDataFrame([(first_id + i, *[_cell(r.get(f.name), f.dataType) for f in schema.fields[1:]]) for i, r in enumerate(rows)], schema)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The objects of JSON-lines files; Spark merges their keys."""
    return spark.read.json(path)
