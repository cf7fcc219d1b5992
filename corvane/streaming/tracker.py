"""The query log as a stream: running statistics, and windowed ones that drop late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def log_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def running(log: DataFrame) -> DataFrame:
    """Queries, latency sum and mean by agent over the whole stream; write it in complete or update mode."""
    return log.groupBy(F.col("event_type").alias("agent")).agg(F.count("*").alias("invocations"), F.sum("value").alias("total_ms"), F.round(F.avg("value"), 1).alias("avg_ms"))


def windowed(log: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same by event-time window, with state that a watermark ends; append mode."""
    timed = log.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", length), F.col("event_type").alias("agent")).agg(F.count("*").alias("invocations"), F.avg("value").alias("avg_ms"))


def write(stats: DataFrame, path: str, checkpoint: str, mode: str = "complete"):
    """Keeps the latest complete result, or appends finished windows, as Parquet."""
    if mode == "append":
        return stats.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    return stats.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
