"""The hourly resampling and the session cut as streaming queries, equal to their batch forms on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hourly(events: DataFrame, time: str = "ts", key: str = "user_id", value: str = "value", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Count and mean for each key and tumbling window; on a stream, late rows are kept up to the watermark."""
    timed = events.withColumn("_at", F.col(time).cast("timestamp"))
    timed = timed.withWatermark("_at", late) if events.isStreaming else timed
    out = timed.groupBy(key, F.window("_at", width)).agg(F.count(value).alias("sample_count"), F.avg(value).alias("value_mean"))
    return out.select(key, F.col("window.start").alias("window_start"), "sample_count", "value_mean")


def activity_sessions(events: DataFrame, gap: str, time: str = "ts", key: str = "user_id", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("_at", F.col(time).cast("timestamp"))
    timed = timed.withWatermark("_at", late) if events.isStreaming else timed
    out = timed.groupBy(key, F.session_window("_at", gap).alias("s")).agg(F.count(F.lit(1)).alias("n_events"))
    return out.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events")


def run_to_table(query: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop."""
    query.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
