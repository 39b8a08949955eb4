"""CSV ingestion with an explicit schema, Parquet conversion, column scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_options(delimiter: str = ",", multi_line: bool = False) -> dict[str, object]:
    """Reader options: RFC 4180 quoting, no header, any malformed row is an error."""
    return {
        "sep": delimiter,
        "quote": '"',
        "escape": '"',
        "multiLine": multi_line,
        "mode": "FAILFAST",
        "header": False,
        "emptyValue": "",
        "dateFormat": "yyyy-MM-dd",
        "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
        "ignoreLeadingWhiteSpace": False,
        "enforceSchema": True,
    }


def without_nulls(df: DataFrame) -> DataFrame:
    """Strings: null becomes ''. Any other null raises, as data have no nulls."""
    out = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            c = F.coalesce(c, F.lit(""))
        else:
            message = F.lit(f"empty value in column {field.name}")
            c = F.when(c.isNull(), F.raise_error(message).cast(field.dataType)).otherwise(c)
        out.append(c.alias(field.name))
    return df.select(*out)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    delimiter: str = ",",
    multi_line: bool = False,
) -> DataFrame:
    """Headerless CSV as a DataFrame without nulls.

    Large files are split at lines. ``multi_line=True`` allows line breaks in quoted
    fields, at the price of one task a file; without it such a field is an error.
    """
    reader = spark.read.schema(schema).options(**csv_options(delimiter, multi_line))
    return without_nulls(reader.csv(path))


def convert(
    spark: SparkSession,
    schema: T.StructType,
    data: str,
    output: str,
    partition_by: Sequence[str] = (),
    multi_line: bool = False,
) -> None:
    """CSV to Parquet."""
    df = read_csv(spark, data, schema, multi_line=multi_line)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(output)


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The listed columns of a Parquet table: None is all, [] is rows without columns."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*[F.col(f"`{c}`") for c in columns])
