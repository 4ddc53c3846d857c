"""Structured Streaming forms of the ingestion, retry, refresh and session work."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docloom.fixed_values import (
    ALLOWED_LATENESS,
    EXCHANGE_MAX_VERSIONS,
    INGESTION_WINDOW,
    RETRY_WINDOW,
)
from docloom.operators import errors, index
from docloom.plans import ingestion
from docloom.session import materialise
from docloom.sources import files, messages, sinks
from docloom.sources.versions import Store
from docloom.streaming import state

# --- windows -------------------------------------------------------------------


def window_counts(stream: DataFrame, length: str = INGESTION_WINDOW, lateness: str = ALLOWED_LATENESS) -> DataFrame:
    """Messages per tumbling window.

    Rows later than ``lateness`` are dropped.  In append mode a window comes out once,
    when the watermark has passed its end, with the late rows that were still allowed.
    """
    return (
        stream.withWatermark("ts", lateness)
        .groupBy(F.window("ts", length).alias("w"))
        .agg(F.count("*").alias("messages"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "messages")
    )


def retry_counts(stream: DataFrame) -> DataFrame:
    """Failures per ten-minute window."""
    return window_counts(stream, RETRY_WINDOW)


def deduplicate(stream: DataFrame) -> DataFrame:
    return index.distinct_ids_streaming(stream)


def ids_per_window(stream: DataFrame, length: str = INGESTION_WINDOW, lateness: str = ALLOWED_LATENESS) -> DataFrame:
    """Each id once in every window it occurs in, however the stream is cut into batches.

    The window is part of the key, so the state of a window ends when the watermark has passed it.
    """
    return (
        stream.withWatermark("ts", lateness)
        .select("id", F.window("ts", length).alias("w"))
        .dropDuplicates(["id", "w"])
        .select("id", F.col("w.start").alias("window_start"))
    )


def run_available(stream: DataFrame, folder: str, checkpoint: str) -> list[dict]:
    """Read what there is now into a parquet folder; the progress of its batches.

    Called again with the same checkpoint it goes on where it stopped.
    """
    run = append_to(stream, folder, checkpoint, availableNow=True)
    run.awaitTermination()
    return [json.loads(p.json) if hasattr(p, "json") else p for p in run.recentProgress]


# --- running a stream ----------------------------------------------------------


def append_to(stream: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the rows of a stream to a parquet folder."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": INGESTION_WINDOW}))
        .start(folder)
    )


@dataclass(frozen=True)
class Batch:
    """A micro-batch: the query keeps its id with its checkpoint, so a repeated batch has one name."""

    query: str
    number: int

    @property
    def name(self) -> str:
        return f"{self.query}-{self.number:012d}"


def each_batch(
    stream: DataFrame, handle: Callable[[DataFrame, Batch], None], checkpoint: str, **trigger
) -> StreamingQuery:
    """Hand every micro-batch, and which it is, to a batch function."""

    def named(rows: DataFrame, number: int) -> None:
        query = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        handle(rows, Batch(query or checkpoint, number))

    return (
        stream.writeStream.foreachBatch(named)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": INGESTION_WINDOW}))
        .start()
    )


# --- ingestion -----------------------------------------------------------------


def ingestion_handler(
    file_store: ingestion.FileStore,
    store: Store,
    error_folder: str,
    retry_folder: str,
    models: ingestion.Models | None = None,
    lines_folder: str | None = None,
    maintain: bool = True,
) -> Callable[[DataFrame, Batch], None]:
    """Batch function: index what can be indexed, put retries and errors aside.

    A batch that is repeated after a failure ends in the same state: the store knows the last batch of
    each query, errors and retries lie in one folder a batch, and lines are replaced.
    """

    def handle(rows: DataFrame, batch: Batch) -> None:
        result = ingestion.ingest_messages(rows, file_store, models)
        found = materialise(result.errors, "errors")
        if lines_folder:
            sinks.write_content_lines(result.contents, lines_folder)
        sinks.write_errors(errors.discardable(found), error_folder, batch.name)
        messages.publish(errors.retry_messages(found), retry_folder, batch.name)
        ingestion.store_rows(result.rows, store, F.current_timestamp(), batch.query, batch.number)
        if maintain:
            ingestion.maintain_store(store)

    return handle


def start_ingestion(
    stream: DataFrame, handle: Callable[[DataFrame, Batch], None], checkpoint: str, **trigger
) -> StreamingQuery:
    return each_batch(stream, handle, checkpoint, **trigger)


def start_requeue(
    retries: DataFrame, message_folder: str, checkpoint: str, window: str = RETRY_WINDOW, **trigger
) -> StreamingQuery:
    """Release held retries back into the message stream when their window is over by the clock."""
    with state.rocksdb(retries.sparkSession):
        return each_batch(
            state.release_by_clock(retries, window),
            lambda rows, batch: messages.publish(rows, message_folder, batch.name),
            checkpoint,
            **trigger,
        )


def start_all(
    stream: DataFrame,
    handle: Callable[[DataFrame, Batch], None],
    retry_folder: str,
    message_folder: str,
    checkpoint: str,
    window: str = RETRY_WINDOW,
    **trigger,
) -> tuple[StreamingQuery, StreamingQuery]:
    """The ingestion of a message folder together with the release of what failed in it."""
    spark = stream.sparkSession
    files.make_folder(spark, retry_folder)
    retries = messages.stream_messages(spark, retry_folder)
    return (
        start_ingestion(stream, handle, f"{checkpoint}/ingestion", **trigger),
        start_requeue(retries, message_folder, f"{checkpoint}/requeue", window, **trigger),
    )


# --- session state -------------------------------------------------------------


class SessionExchanges(StatefulProcessor):
    """Newest exchanges of one session, forgotten when they are too old."""

    def __init__(self, versions: int = EXCHANGE_MAX_VERSIONS, max_age_ms: int = 3_600_000):
        self.versions, self.max_age_ms = versions, max_age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "ts timestamp, exchange string", ttlDurationMs=self.max_age_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # no more than the newest few rows are held at any time, however many arrive
        kept = pd.DataFrame(list(self.kept.get()), columns=["ts", "exchange"])
        for batch in rows:
            kept = pd.concat([kept, batch[["ts", "exchange"]]]) if len(kept) else batch[["ts", "exchange"]]
            kept = kept.sort_values(["ts", "exchange"], ascending=[False, True]).head(self.versions)
        self.kept.put([(row.ts.to_pydatetime(), row.exchange) for row in kept.itertuples()])
        yield kept.sort_values("ts").assign(session=key[0])[["session", "ts", "exchange"]]

    def close(self) -> None:
        pass


def session_state(exchanges: DataFrame, versions: int = EXCHANGE_MAX_VERSIONS, max_age_ms: int = 3_600_000) -> DataFrame:
    """Current exchanges of every session that got new ones; needs the RocksDB state store."""
    return exchanges.groupBy("session").transformWithStateInPandas(
        SessionExchanges(versions, max_age_ms),
        outputStructType="session string, ts timestamp, exchange string",
        outputMode="update",
        timeMode="processingTime",
    )
