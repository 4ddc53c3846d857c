"""The ingestion message stream: reading it, and publishing to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources import files
from docloom.sources.schemas import MESSAGES


def read_messages(spark: SparkSession, folder: str) -> DataFrame:
    """All messages of a JSON message folder, those of finished batches in folders of their own included."""
    return spark.read.schema(MESSAGES).option("recursiveFileLookup", "true").json(folder)


def stream_messages(spark: SparkSession, folder: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Messages of a JSON message folder as they arrive."""
    return (
        spark.readStream.schema(MESSAGES)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .option("recursiveFileLookup", "true")
        .json(folder)
    )


def stream_kafka_messages(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Messages of a Kafka topic; needs the Kafka connector on the cluster."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("includeHeaders", "true")
        .load()
    )
    return raw.select(
        F.col("timestamp").alias("ts"),
        F.col("value").cast("string").alias("payload"),
        F.map_from_entries(
            F.transform("headers", lambda h: F.struct(h["key"], h["value"].cast("string")))
        ).alias("attributes"),
    )


MICROSECONDS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def publish(messages: DataFrame, folder: str, batch: str | None = None) -> None:
    """Append messages; a stream over the same folder picks them up.

    With the name of a batch they are published once, however often the batch is repeated.
    """
    rows = messages.select("ts", "payload", "attributes")
    if batch is None:
        rows.write.mode("append").option("timestampFormat", MICROSECONDS).json(folder)
    else:
        files.write_once(rows, folder, batch, timestampFormat=MICROSECONDS)


def publish_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    headers = F.transform(
        F.map_entries("attributes"), lambda e: F.struct(e["key"], e["value"].cast("binary"))
    )
    (
        messages.select(F.col("payload").alias("value"), headers.alias("headers"))
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )
