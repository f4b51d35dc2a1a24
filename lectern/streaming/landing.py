"""Documents that arrive: each micro-batch of whole documents runs the batch plan.

All operators look at one document at a time, so no state crosses batches and a document is complete when it lands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run_on_arrival(spark: SparkSession, path: str, schema: str, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parquet files below path, by batch, through plan to Parquet below out. A batch written again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(path)
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def event_counts(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """window_start, event_type, n, total of events over tumbling windows; works on batches and, with the watermark, on streams."""
    x = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        x = x.withWatermark("at", late)
    g = x.groupBy(F.window("at", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
