"""Session defaults the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Settings that change results (time zone, ANSI errors) or plans (AQE, pushdown).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def build_session(
    master: str | None = None, app: str = "tarnfall", **extra: str
) -> SparkSession:
    """A session with the defaults; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Where none is set, one machine makes a temporary one; a cluster is an error, as
    its executors wouldn't find a folder of the driver's."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tarnfall')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")
