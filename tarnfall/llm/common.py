"""Shared storage and small helpers of the operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfall.session import shared_dir

#: Broadcast limit for row-id sets that were counted first (8 bytes an id, about 64 MB built).
MAX_BROADCAST_IDS = 2_000_000


#: Rows of an Arrow batch where the session has Spark's own 10,000: texts are long.
BATCH_ROWS = 2000


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Before an operator sends functions to executors: once for each application its
    package is sent along, and Arrow batches are kept small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    package = Path(__file__).resolve().parents[1]
    if spark.sparkContext.applicationId in _shipped or not package.is_dir():
        return
    path = f"{tempfile.mkdtemp(prefix='tarnfall')}/tarnfall.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, str(file.relative_to(package.parent)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(spark.sparkContext.applicationId)


def release_memory() -> None:
    """Gives a worker's free memory back, as the worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A mapInArrow function that leaves no free memory in its worker."""

    def inner(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return inner


#: Folders that this process has made, in order.
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in list(paths):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        if path in _made:
            _made.remove(path)


def clear(spark: SparkSession) -> None:
    """Deletes every table that operators have left in the shared folder. DataFrames that
    they returned read those tables, so only when all results have been used."""
    delete(spark, _made)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """The rows of make() as a table in the shared folder, and its path. What was written
    there on the way is deleted."""
    before = set(_made)
    rows, path = make(), new_path(spark, name)
    rows.write.parquet(path)
    delete(spark, [p for p in _made if p not in before and p != path])
    return spark.read.schema(rows.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and survives the
    loss of executors."""
    return Scratch(df.sparkSession).written(df, name)


#: A key with more rows is dealt over several tasks; at most MAX_HOT_KEYS keys are.
HOT_ROWS, MAX_HOT_KEYS = 1000, 50_000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], n: str, by: Column) -> DataFrame:
    """The inner join of many left rows with right, a written table that has one row a key
    and, as ``n``, the number of its left rows.

    The few keys with many rows (or the largest one) are broadcast with their number of
    salts; their left rows are dealt over the salts by ``by``, and their right row is there
    once for each salt, so no key meets in one task. One plan for every size."""
    rows, largest = right.agg(F.sum(n), F.max(n)).first()
    most = max(HOT_ROWS, (rows or 0) // MAX_HOT_KEYS)
    hot = right.where(F.col(n) > most) if (largest or 0) > most else right.orderBy(F.desc(n), *on).limit(1)
    salts = F.ceil(F.col(n) / most).cast("int")
    left = left.join(F.broadcast(hot.select(*on, salts.alias("_salts"))), on, "left")
    left = left.withColumn("_salt", F.pmod(by, F.coalesce("_salts", F.lit(1))).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, [*on, "_salt"]).drop("_salt", "_salts")


class Scratch:
    """Tables in the shared folder that can be deleted once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, list[str]] = {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.paths.pop(name, []))


#: Words: runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def fold(doc_id, n: int):
    """crc32 of the id's decimal text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n
