"""The audit log as a stream: files of events as they come, windowed counts with a watermark, sessions, and upserts by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbmark.operators.audit import TABLES, latest


def events(spark: SparkSession, path: str, schema: str = TABLES["stage_events"]) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def hourly(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """hour, stage, level, count; rows later than the watermark are left out."""
    return log.withWatermark("timestamp", late).groupBy(F.window("timestamp", "1 hour").alias("hour"), "stage", "level").agg(F.count("*").alias("cnt"))


def sessions(log: DataFrame, key: str = "run_id", gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    return log.withWatermark("timestamp", late).groupBy(F.session_window("timestamp", gap).alias("session"), key).agg(F.count("*").alias("cnt"))


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's latest row of each key; what is on file takes everything available, then ends."""

    def batch(df: DataFrame, number: int) -> None:
        latest(df, ["run_id", "stage", "tag", "field"], F.col("seq")).write.mode("append").parquet(path)

    return counts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
