"""Streams: validation of raw records into accepted and dead-letter sinks, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def read_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """key, value, timestamp of a Kafka topic (needs Spark's Kafka package)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")


def validate_events(events: DataFrame) -> DataFrame:
    """events with k (from props) and error: null where the record is sound. Works on streams and tables alike."""
    k = F.from_json("props", "k long")["k"]
    error = F.when(F.col("event_type").isNull(), "event_type: field required").when(k.isNull(), "props: not a JSON object with k").when(F.col("value") < 0, "value: must be at least 0")
    return events.withColumn("k", k).withColumn("error", error)


def split_sinks(events: DataFrame, accepted: str, dead: str, checkpoint: str) -> StreamingQuery:
    """One query that writes sound records to ``accepted`` and the others to ``dead`` in every batch.

    A batch's number is in its folder's name and overwrites what a failed
    attempt left, so records land once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            batch.where("error is null").drop("error").write.mode("overwrite").parquet(f"{accepted}/batch={number}")
            batch.where("error is not null").write.mode("overwrite").parquet(f"{dead}/batch={number}")
        finally:
            batch.unpersist()

    return validate_events(events).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and mean value by window and type; later events than ``late`` are dropped by the watermark."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("avg_value")).select(F.col("w.start").alias("start"), "event_type", "n", "avg_value")
