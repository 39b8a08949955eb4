"""CSV files dropped in a folder become Parquet as they arrive.

The batch reader's options and null rules hold, and a checkpoint makes every
file count once. Builder queries also run on the streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tarnfall.sources.tables import csv_options, without_nulls


def stream_convert(
    spark: SparkSession, schema: T.StructType, folder: str, output: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Starts the stream; ``once`` takes what is there and stops."""
    df = without_nulls(spark.readStream.schema(schema).options(**csv_options()).csv(folder))
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(output)
