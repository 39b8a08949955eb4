"""Queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnfall.plans.hits import hits, hits_sql
from tarnfall.plans.ingest import CSV_CONVERT_SQL, RESULT_SINK_SQL, csv_convert, result_sink
from tarnfall.plans.query import Query
from tarnfall.plans.suite import SUITE
from tarnfall.plans.workload import WORKLOAD

QueryFn = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, QueryFn]:
    out: dict[str, QueryFn] = {}
    for k, item in WORKLOAD.items():
        out[f"hits_q{k}"] = lambda spark, d, item=item: item.build(Query(hits(spark, d))).df
    for name, item in SUITE.items():
        out[name] = lambda spark, d, item=item: item.build(Query.scan(spark, f"{d}/{item.table}.parquet")).df
    return out | {"csv_convert": csv_convert, "result_sink": result_sink}


def oracle_sql() -> dict[str, str]:
    view = hits_sql()
    out = {f"hits_q{k}": f"WITH hits AS ({view}) {item.sql}" for k, item in WORKLOAD.items()}
    return out | {name: item.sql for name, item in SUITE.items()} | {"csv_convert": CSV_CONVERT_SQL, "result_sink": RESULT_SINK_SQL}
