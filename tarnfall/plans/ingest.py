"""Ingestion as a query: rows to CSV files, their conversion to Parquet, a column scan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfall.session import shared_dir
from tarnfall.sources.sink import lines
from tarnfall.sources.tables import convert, scan
from tarnfall.types import parse_schema

SCHEMA = "o_orderkey,int64\no_orderstatus,string\no_orderpriority,string\nday,DATE\nat,TIMESTAMP\nnote,string\n"


def csv_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders through CSV, with quotes, commas and empty strings in a column."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    note = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit('say "'), "o_orderstatus", F.lit('", ok')))
    rows = orders.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date").alias("day"),
        F.date_trunc("second", "o_orderdate").cast("timestamp_ntz").alias("at"), note.alias("note"),
    )
    folder = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    options = {"quote": '"', "escape": '"', "emptyValue": "", "dateFormat": "yyyy-MM-dd", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}
    rows.write.options(**options).csv(f"{folder}/csv")
    convert(spark, parse_schema(SCHEMA), f"{folder}/csv", f"{folder}/table")
    return scan(spark, f"{folder}/table", [line.split(",")[0] for line in SCHEMA.split()])


CSV_CONVERT_SQL = """
SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS day,
       date_trunc('second', o_orderdate) AS at,
       CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('say "', o_orderstatus, '", ok') END AS note
FROM orders
"""


def result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as lines of raw and of quoted text."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", F.concat("o_orderstatus", F.lit(', "'), "o_orderpriority", F.lit('"')).alias("note"),
        F.col("o_orderdate").cast("date").alias("day"), F.date_trunc("second", "o_orderdate").cast("timestamp_ntz").alias("at"),
    )
    raw = lines(orders).select(F.lit("raw").alias("mode"), "line")
    return raw.unionByName(lines(orders, quoted=True).select(F.lit("quoted").alias("mode"), "line"))


RESULT_SINK_SQL = '''
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, CAST(o_orderdate AS DATE) AS day,
                  strftime(date_trunc('second', o_orderdate), '%Y-%m-%d %H:%M:%S') AS sec FROM orders)
SELECT 'raw' AS mode, concat(k, ',', s, ', "', p, '",', day, ',', sec) AS line FROM a
UNION ALL SELECT 'quoted', concat(k, ',"', s, ', ""', p, '""",', day, ',', sec) FROM a
'''
