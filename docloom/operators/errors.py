"""Classify failures, hold and requeue the retriable ones, describe the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.fixed_values import ALLOWED_LATENESS, MAX_RETRIES, METADATA_RETRY_KEY, RETRY_WINDOW

ERROR_COLUMNS = [
    "kind", "stage", "content_id", "metadata", "retry_count", "element", "class_name", "message", "ts", "request",
]
CLASS_NAMES = {
    "message": "IngestionError",
    "id": "DocumentIdError",
    "content": "DocumentContentError",
    "chunk": "ChunkError",
    "embed": "EmbeddingError",
}
#: Stages at which the same request may succeed another time.
RETRIED = ("id", "content", "chunk", "embed")


def retries(metadata: Column) -> Column:
    """Retry count carried in the metadata, 0 when absent."""
    return F.coalesce(F.try_element_at(metadata, F.lit(METADATA_RETRY_KEY)).try_cast("int"), F.lit(0))


def union_failures(id_failures: DataFrame, message_failures: DataFrame, content_failures: DataFrame) -> DataFrame:
    """The three failure streams in one shape."""

    def of_transport(df: DataFrame, stage: str) -> DataFrame:
        return df.select(
            F.lit(stage).alias("stage"),
            "content_id",
            "metadata",
            F.col("content_id").alias("element"),
            F.col("failure").alias("message"),
            "ts",
        )

    of_message = message_failures.select(
        "stage",
        F.lit(None).cast("string").alias("content_id"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
        "element",
        "message",
        "ts",
    )
    return of_transport(id_failures, "id").unionByName(of_message).unionByName(
        of_transport(content_failures, "content")
    )


def classify(failures: DataFrame) -> DataFrame:
    """A document that could not be found or read, or that a model failed on, is tried again, until it
    was tried too often.

    ``request`` is what is sent then; without that column it is the file named by ``content_id``.
    """
    count = retries(F.col("metadata"))
    again = F.col("stage").isin(*RETRIED) & (count <= MAX_RETRIES)
    request = F.col("request") if "request" in failures.columns else F.lit(None).cast("string")
    return failures.select(
        F.when(again, "retriable").otherwise("discardable").alias("kind"),
        "stage",
        "content_id",
        "metadata",
        F.when(again, count + 1).otherwise(count).alias("retry_count"),
        "element",
        F.coalesce(
            *[F.when(F.col("stage") == s, F.lit(c)) for s, c in CLASS_NAMES.items()], F.lit("Error")
        ).alias("class_name"),
        "message",
        "ts",
        F.when(again, request).alias("request"),
    )


def retriable(errors: DataFrame) -> DataFrame:
    return errors.filter(F.col("kind") == "retriable")


def discardable(errors: DataFrame) -> DataFrame:
    return errors.filter(F.col("kind") == "discardable")


def retry_messages(errors: DataFrame) -> DataFrame:
    """A full ingestion request with the retry count raised in the attributes."""
    body = F.to_json(
        F.struct(F.array(F.struct(F.col("content_id").alias("urlOrId"))).alias("googleDrive"))
    )
    others = F.map_filter(
        F.coalesce("metadata", F.create_map().cast("map<string,string>")),
        lambda k, _: k != METADATA_RETRY_KEY,
    )
    attributes = F.map_concat(
        others, F.create_map(F.lit(METADATA_RETRY_KEY), F.col("retry_count").cast("string"))
    )
    payload = F.coalesce("request", body) if "request" in errors.columns else body
    return retriable(errors).select("ts", payload.alias("payload"), attributes.alias("attributes"))


def error_strings(errors: DataFrame) -> DataFrame:
    """Description of each discarded element."""
    return discardable(errors).select(
        "ts",
        "element",
        F.to_json(F.struct(F.col("class_name").alias("className"), F.col("message"))).alias("error"),
    )


def hold_retries(messages: DataFrame, lateness: str = ALLOWED_LATENESS) -> DataFrame:
    """Keep retries until their ten-minute window has closed, then release them.

    Every distinct message is its own group, counted on the map side, so a window full of
    failures spreads over all tasks and no list of messages is ever built.  Works on a
    stream (append mode) and on a table.
    """
    # recomputed, because a stream may have one event time column only
    sent_at = F.timestamp_micros(F.unix_micros("ts"))
    held = (
        messages.withColumn("a", F.to_json("attributes"))
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", RETRY_WINDOW).alias("w"), sent_at.alias("sent_at"), "payload", "a")
        .agg(F.count("*").cast("int").alias("copies"))
    )
    return held.select(
        F.col("w.end").alias("released_at"),
        F.col("sent_at").alias("ts"),
        "payload",
        F.from_json("a", "map<string,string>").alias("attributes"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_copy"),
    ).drop("_copy")
