"""A web-analytics table derived from the ``events`` and ``pages`` tables.

Every expression is valid in Spark SQL and in DuckDB, so both sides of a
comparison build the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> (type, expression over e, p and r)
COLUMNS: dict[str, tuple[str, str]] = {
    "WatchID": ("bigint", "e.event_id"),
    "UserID": ("bigint", "e.user_id"),
    "EventTime": ("timestamp", "date_trunc('second', e.ts)"),
    "EventDate": ("date", "CAST(e.ts AS DATE)"),
    "CounterID": ("int", "e.user_id % 5 + 60"),
    "RegionID": ("int", "e.user_id % 25"),
    "ClientIP": ("int", "e.user_id * 7919"),
    "AdvEngineID": ("smallint", "CASE WHEN e.event_type = 'click' THEN e.event_id % 4 ELSE 0 END"),
    "SearchEngineID": ("smallint", "e.event_id % 3"),
    "TraficSourceID": ("smallint", "e.event_id % 8 - 1"),
    "ResolutionWidth": ("smallint", "e.event_id % 1920"),
    "IsRefresh": ("smallint", "CASE WHEN e.event_type = 'error' THEN 1 ELSE 0 END"),
    "DontCountHits": ("smallint", "CASE WHEN e.event_id % 10 = 0 THEN 1 ELSE 0 END"),
    "IsLink": ("smallint", "CASE WHEN e.event_type = 'click' THEN 1 ELSE 0 END"),
    "IsDownload": ("smallint", "CASE WHEN e.event_type = 'purchase' THEN 1 ELSE 0 END"),
    "SearchPhrase": ("string", "CASE WHEN e.event_type IN ('view', 'click') THEN e.props ELSE '' END"),
    "MobilePhone": ("smallint", "e.event_id % 6"),
    "MobilePhoneModel": (
        "string",
        "CASE WHEN e.event_id % 6 = 0 THEN '' ELSE concat('M', CAST(e.user_id % 9 AS STRING)) END",
    ),
    "URL": ("string", "CASE WHEN e.event_id % 11 = 0 THEN '' ELSE coalesce(p.url, '') END"),
    "Referer": ("string", "CASE WHEN e.event_id % 13 = 0 THEN '' ELSE coalesce(r.url, '') END"),
    "Title": ("string", "CASE WHEN e.event_id % 7 = 0 THEN '' ELSE concat('Page ', coalesce(p.url, '')) END"),
    "URLHash": ("bigint", "e.event_id % 17"),
    "RefererHash": ("bigint", "e.event_id % 5"),
    "WindowClientWidth": ("smallint", "e.event_id % 40"),
    "WindowClientHeight": ("smallint", "e.event_id % 30"),
}


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").alias("e")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    count = max(pages.count(), 1)
    # Spark broadcasts the pages if their size allows it.
    df = e.join(pages.alias("p"), F.expr(f"p.page_id = e.event_id % {count}"), "left")
    df = df.join(pages.alias("r"), F.expr(f"r.page_id = (e.event_id * 3) % {count}"), "left")
    out = []
    for name, (kind, expr) in COLUMNS.items():
        kind = "timestamp_ntz" if kind == "timestamp" else kind
        out.append(F.expr(f"CAST({expr} AS {kind})").alias(name))
    return df.select(*out)


def hits_sql() -> str:
    exprs = ", ".join(f"CAST({expr} AS {kind}) AS {name}" for name, (kind, expr) in COLUMNS.items())
    count = "(SELECT greatest(COUNT(*), 1) FROM pages)"
    return (
        f"SELECT {exprs} FROM events e LEFT JOIN pages p ON p.page_id = e.event_id % {count} "
        f"LEFT JOIN pages r ON r.page_id = (e.event_id * 3) % {count}"
    )
