"""A stream of documents through the same plans as a table.

One document is one row, so a micro-batch holds whole documents, and windows and joins
within documents run on each batch as they run on a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_layer(
    spark: SparkSession, source: str, schema: str, layer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str
) -> StreamingQuery:
    """Reads Parquet documents as they arrive and writes a layer of each batch to ``sink``.

    A batch that runs again replaces its own folder, so each document is stored once.
    """
    docs = spark.readStream.schema(schema).parquet(source)

    def store(batch: DataFrame, number: int) -> None:
        layer(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return docs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their mean value by type and window; works on streams and tables."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", length), "event_type")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n", "mean_value")
    )
