"""The six column types of the data model and schema files."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import types as T

#: Type names of schema files (case-sensitive) and their Spark types.
SPARK_TYPES: dict[str, T.DataType] = {
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "string": T.StringType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(),
}


def parse_schema(text: str) -> T.StructType:
    """A StructType from headerless ``name,type`` lines.

    Raises ValueError for an unknown type, a missing column or a repeated name.
    """
    fields: dict[str, T.StructField] = {}
    for number, row in enumerate(csv.reader(text.splitlines()), start=1):
        if not row:
            continue
        if len(row) != 2:
            raise ValueError(f"schema line {number}: expected name,type, got {row!r}")
        name, kind = row[0].strip(), row[1].strip()
        if kind not in SPARK_TYPES:
            raise ValueError(f"schema line {number}: unknown type {kind!r}")
        if not name or name in fields:
            raise ValueError(f"schema line {number}: empty or repeated name {name!r}")
        fields[name] = T.StructField(name, SPARK_TYPES[kind], True)
    if not fields:
        raise ValueError("the schema is empty")
    return T.StructType(list(fields.values()))


def read_schema(path: str) -> T.StructType:
    return parse_schema(Path(path).read_text(encoding="utf-8"))


def format_schema(schema: T.StructType) -> str:
    """The inverse of parse_schema."""
    names = {kind: name for name, kind in SPARK_TYPES.items()}
    try:
        return "".join(f"{f.name},{names[f.dataType]}\n" for f in schema)
    except KeyError as error:
        raise ValueError(f"type outside the data model: {error.args[0]}") from error
