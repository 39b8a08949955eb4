"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 48-bit hash of its id. A source that needs t words of its s
takes each document floor(t / s) times and once more where the hash lies below a
threshold. The threshold comes from nested histograms: words by source and the
hash's first 12 bits give the boundary bucket, and only that bucket is refined by
the next 12 bits, four times. Nothing is sorted, and reruns agree. DataFrame
functions only.

Targets: the budget is dealt by weight; a target above ``cap`` times its source's
size stops there and the excess is dealt again until none is above. With sources
in the order of cap / weight this has a closed form: the first source that its
share of what is left doesn't exceed gives the level of all that follow.

Defined results: a null text has size 0; a very long text counts whole; null is a source of its own, last in
order; documents with one id share their fate; a table without words takes
nothing; an empty table gives no rows; extra columns are carried untouched.
Skew: all sums are pre-aggregated by source and bucket, so no source is ever in
one task; what is windowed are histograms of at most 4096 rows a source and one row
a source. The sources' rows are broadcast if they are few, else joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfall.llm.common import MAX_BROADCAST_IDS, WORD, written

WEIGHTS = (5, 2, 1)
CAP = 3
BITS, LEVELS = 12, 4


def id_hash(id_col: str):
    """The first 48 bits of the MD5 of the id's decimal text."""
    digits = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digits, 1, BITS * LEVELS // 4), 16, 10).cast("bigint")


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("bigint").alias("size"),
        id_hash(id_col).alias("h"),
    )


def small(df: DataFrame) -> DataFrame:
    """Broadcast, if its written rows are few."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_IDS // 4 else df


def targets(sized: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """A row for each source: source_size, target, copies (whole ones), rest (words)."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight.cast("bigint"))
    s = s.withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - (F.sum("most").over(before) - F.col("most"))
    s = s.withColumn("level", left / F.sum("weight").over(after))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
    target = F.when(F.col("ratio") < F.col("level"), F.col("most").cast("double")).otherwise(F.col("weight") * F.col("level"))
    s = s.withColumn("target", target)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    s = s.withColumn("copies", copies)
    return s.select("source", "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with ``threshold``: the smallest hash left out, null if none is.

    The state after each level, a row a source, is written, so plans stay small."""
    state = goals.withColumn("prefix", F.lit(0).cast("bigint")).withColumn("open", F.lit(True)).withColumn("used", F.lit(0).cast("bigint"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        at = sized.withColumnRenamed("source", "s")
        at = at.join(
            small(state.select("source", "prefix", "open")),
            F.col("s").eqNullSafe(F.col("source")) & F.col("open") & (F.shiftright("h", shift + BITS) == F.col("prefix")),
        )
        hist = at.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("sum", F.sum("words").over(along))
        hist = hist.join(state.select(F.col("source").alias("s"), "used", "rest"), F.col("source").eqNullSafe(F.col("s")))
        over = F.when(F.col("used") + F.col("sum") > F.col("rest"), F.struct("bucket", (F.col("used") + F.col("sum") - F.col("words")).alias("used")))
        edge = hist.groupBy(F.col("source").alias("s")).agg(F.min(over).alias("edge"))
        state = state.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select(
            *goals.columns,
            F.col("edge.bucket").alias("prefix"),
            F.col("edge").isNotNull().alias("open"),
            F.coalesce(F.col("edge.used"), F.col("used")).alias("used"),
        )
        state = written(state, "mix-level")
    return state.select(*goals.columns, F.col("prefix").alias("threshold"))


def plan(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(documents as id, source, size and h; sources with target, copies, rest, threshold)."""
    sized = written(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    goals = written(targets(sized, weights, cap), "mix-targets")
    return sized, thresholds(sized, goals)


def taken_copies(cap: int):
    extra = (F.col("rest") > 0) & (F.col("threshold").isNull() | (F.col("h") < F.col("threshold")))
    return F.least(F.col("copies") + F.when(extra, 1).otherwise(0), F.lit(cap)).cast("bigint")


def mix(docs: DataFrame, cap: int = CAP, **options) -> DataFrame:
    """A row for each document: id, source, size, source_size, target and copies."""
    sized, marks = plan(docs, cap=cap, **options)
    out = sized.join(small(marks).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return out.select("id", "source", "size", "source_size", "target", taken_copies(cap).alias("copies"))


def mixed(docs: DataFrame, cap: int = CAP, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The documents taken at least once, with their columns and ``copies``, how often.

    The copies follow from the source's threshold and the hash, so texts aren't
    moved; an input column named copies is replaced."""
    _, marks = plan(docs, cap=cap, id_col=id_col, source_col=source_col, **options)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "copies"]).alias("row")
    rows = docs.select(row, F.col(source_col).alias("source"), id_hash(id_col).alias("h"))
    out = rows.join(small(marks).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return out.select("row.*", taken_copies(cap).alias("copies")).where(F.col("copies") > 0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rk FROM s0),
s2 AS (SELECT *, CAST(CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight,
              source_size * 3 AS most FROM s1),
s3 AS (SELECT *, CAST(most AS DOUBLE) / weight AS ratio FROM s2),
s4 AS (SELECT *, CAST(sum(source_size) OVER () - (sum(most) OVER (ORDER BY ratio, rk ROWS UNBOUNDED PRECEDING) - most)
                 AS DOUBLE) / CAST(sum(weight) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                 AS DOUBLE) AS lv FROM s3),
s5 AS (SELECT *, (SELECT lv FROM s4 WHERE lv <= ratio ORDER BY ratio, rk LIMIT 1) AS level FROM s4),
s6 AS (SELECT *, CASE WHEN ratio < level THEN CAST(most AS DOUBLE) ELSE weight * level END AS target FROM s5),
s7 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM s6),
m AS (SELECT d.doc_id, d.size, s7.source_size, s7.target, s7.copies,
             s7.target - s7.copies * s7.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS cum
      FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(copies + CASE WHEN rest > 0 AND cum <= rest THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM m
"""
