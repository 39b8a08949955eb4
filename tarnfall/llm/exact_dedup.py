"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised texts by their beginnings (and, behind
equal beginnings, by a hash), an external sort places equal texts side by side, and a
window over neighbours with fully equal bytes gives each run its keeper and size.
DataFrame functions only.

Skew: texts with more than ``hot_rows`` rows, or more than a MAX_HOT_TEXTS-th of all rows
(so at most MAX_HOT_TEXTS, found by a pre-aggregated count of 64-bit hashes and broadcast)
are salted by id, with a salt for so many rows, and a run of copies spreads over many ranges;
their runs' keepers, one row a salt, are put together by SHA-256 and joined back.

Defined results: a null text equals an empty text; a very long text is compared whole; a
row without an id is kept only if its group has no other, and keep_id is then null; of
repeated rows with the kept id, or of rows without any, exactly one is kept; an empty table gives no rows; extra columns are carried
untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfall.llm.common import written

#: A text with more rows is salted.
HOT_ROWS, MAX_HOT_TEXTS = 1000, 20_000
#: Characters that splitters hold of a text; behind them its hash orders texts with one
#: beginning, so that the sample sent to the driver stays small.
PREFIX = 32


def content_sort(
    docs: DataFrame,
    keep: str = "min",
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda c: c,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All rows as ``row`` (a struct of the input's columns) with keep_id, group_size,
    kept and text_sha256. ``keep`` is the id that stays: min or max."""
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    best = F.max if keep == "max" else F.min
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), text.alias("t"))

    hashes = written(rows.groupBy(F.xxhash64("t").alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    most = max(hot_rows, docs.count() // MAX_HOT_TEXTS)
    hot = hashes.where(F.col("n") > most)
    if hot.isEmpty():  # one plan for every size: the most frequent text, in one salt
        hot = hashes.orderBy(F.desc("n"), "h").limit(1)
    hot = hot.select("h", F.ceil(F.col("n") / most).cast("int").alias("salts"))
    rows = rows.withColumn("h", F.xxhash64("t")).join(F.broadcast(hot), "h", "left")
    own = F.when(F.col("id").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("id"))
    salt = F.coalesce(F.pmod(own, F.col("salts")) + 1, F.lit(0))
    rows = rows.select("row", "id", "t", "h", F.substring("t", 1, PREFIX).alias("head"), salt.cast("int").alias("salt"))
    ranged = rows.repartitionByRange("head", "h", "salt")

    # The keeper is the last row of its run for max, the first for min; null ids lose.
    run = Window.partitionBy("head", "h", "salt", "t")
    order = F.col("id").desc_nulls_last() if keep == "max" else F.col("id").asc_nulls_last()
    runs = ranged.select(
        "row",
        "id",
        "salt",
        F.sha2(F.col("t").cast("binary"), 256).alias("sha"),
        F.row_number().over(run.orderBy(order)).alias("rank"),
        F.count(F.lit(1)).over(run).alias("run_size"),
        best("id").over(run).alias("run_keep"),
    )
    heads = runs.where((F.col("rank") == 1) & (F.col("salt") > 0))
    whole = heads.groupBy(F.col("sha").alias("hot_sha")).agg(
        F.sum("run_size").alias("size"), best("run_keep").alias("best"), F.min("salt").alias("first_salt")
    )  # one row for each hot text: at most MAX_HOT_TEXTS
    runs = runs.join(F.broadcast(whole), (F.col("salt") > 0) & (F.col("sha") == F.col("hot_sha")), "left")
    keep_id = F.when(F.col("salt") > 0, F.col("best")).otherwise(F.col("run_keep"))
    size = F.when(F.col("salt") > 0, F.col("size")).otherwise(F.col("run_size"))
    alone = F.col("best").isNotNull() | (F.col("salt") == F.col("first_salt"))  # without any id
    first = (F.col("salt") == 0) | F.col("id").eqNullSafe(F.col("best")) & alone
    return runs.select(
        "row",
        keep_id.alias("keep_id"),
        size.alias("group_size"),
        ((F.col("rank") == 1) & first).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def dedup(docs: DataFrame, keep: str = "min", **options) -> DataFrame:
    """The kept rows, with the input's columns."""
    return content_sort(docs, keep, **options).where("kept").select("row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = content_sort(docs, keep="max")
    return out.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
