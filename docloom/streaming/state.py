"""State that the clock acts on: held retries, and the exchanges of live sessions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.fixed_values import EXCHANGE_MAX_VERSIONS, RETRY_WINDOW

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that the retries of one window are spread over.
LANES = 64
#: Rows that leave a state at once.
PAGE = 1000
HOUR_MS = 3_600_000


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that these operators need; a stream keeps the setting it was started with."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _millis(ts: datetime) -> int:
    return int(round(pd.Timestamp(ts, tz=None if ts.tzinfo else "UTC").timestamp() * 1000))


# --- retries -------------------------------------------------------------------


class HeldRetries(StatefulProcessor):
    """Retries of one lane of one window, released by a timer when the window has ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "ts timestamp, payload string, attributes string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = _millis(key[0])
        late = timerValues.getCurrentProcessingTimeInMs() >= due
        for batch in rows:
            if late:
                yield self._out(key[0], batch)
            else:
                self.held.appendList([(r.ts.to_pydatetime(), r.payload, r.attributes) for r in batch.itertuples()])
        if not late and due not in [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        page: list[tuple] = []
        for row in self.held.get():
            page.append(row)
            if len(page) == PAGE:
                yield self._out(key[0], pd.DataFrame(page, columns=["ts", "payload", "attributes"]))
                page = []
        if page:
            yield self._out(key[0], pd.DataFrame(page, columns=["ts", "payload", "attributes"]))
        self.held.clear()

    @staticmethod
    def _out(window_end, rows: pd.DataFrame) -> pd.DataFrame:
        return rows[["ts", "payload", "attributes"]].assign(released_at=window_end)[["released_at", "ts", "payload", "attributes"]]

    def close(self) -> None:
        pass


def release_by_clock(messages: DataFrame, window: str = RETRY_WINDOW) -> DataFrame:
    """Hold messages until their window has ended by the clock, whatever else arrives or fails to.

    The rows of a window are spread over ``LANES`` groups by their content; a group holds them as a
    list in the state store and sends them on page by page.  A message of a window that has ended
    already passes at once.
    """
    lane = F.pmod(F.xxhash64("payload"), F.lit(LANES)).cast("int")
    grouped = messages.select(
        F.window("ts", window)["end"].alias("window_end"), lane.alias("lane"), "ts", "payload", F.to_json("attributes").alias("attributes")
    ).groupBy("window_end", "lane")
    released = grouped.transformWithStateInPandas(
        HeldRetries(),
        outputStructType="released_at timestamp, ts timestamp, payload string, attributes string",
        outputMode="append",
        timeMode="processingTime",
    )
    return released.withColumn("attributes", F.from_json("attributes", "map<string,string>"))


# --- sessions ------------------------------------------------------------------


class AgingExchanges(StatefulProcessor):
    """The newest exchanges of one session, each gone when its own age is over.

    Time is the watermark where the stream has event time, else the clock.  The state is a map by
    time stamp and text, so an exchange is never renewed by the arrival of others.  A session that
    has none left comes out once with nulls.
    """

    def __init__(self, versions: int, max_age_ms: int, event_time: bool):
        self.versions, self.max_age_ms, self.event_time = versions, max_age_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # By the clock, Spark itself forgets what no timer has removed, some time after its age.
        life = {} if self.event_time else {"ttlDurationMs": 2 * self.max_age_ms}
        self.kept = handle.getMapState("kept", "micros long, exchange string", "ts timestamp", **life)

    def _now(self, timerValues) -> int:
        return timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()

    def _held(self) -> dict[tuple[int, str], datetime]:
        return {(int(k[0]), k[1]): v[0] for k, v in self.kept.iterator()}

    def _add(self, held: dict, rows: pd.DataFrame) -> None:
        for row in rows.itertuples():
            held[int(row.ts.value // 1000 if row.ts.unit == "ns" else row.ts.as_unit("us").value), row.exchange] = row.ts.to_pydatetime()
        for key in sorted(held, key=lambda k: (-k[0], k[1]))[self.versions :]:
            del held[key]

    def _settle(self, held: dict, now: int) -> dict:
        """Store what is young enough, and wait for the oldest of it."""
        before = set(self._held())
        young = {k: v for k, v in held.items() if k[0] // 1000 >= now - self.max_age_ms}
        for key in before - set(young):
            self.kept.removeKey(key)
        for key in set(young) - before:
            self.kept.updateValue(key, (young[key],))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if young:
            self.handle.registerTimer(min(k[0] for k in young) // 1000 + self.max_age_ms + 1)
        return young

    @staticmethod
    def _out(key, held: dict) -> pd.DataFrame:
        rows = [(key[0], ts, exchange) for (_, exchange), ts in sorted(held.items())] or [(key[0], None, None)]
        out = pd.DataFrame(rows, columns=["session", "ts", "exchange"])
        return out.assign(ts=pd.to_datetime(out["ts"]))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        held: dict[tuple[int, str], datetime] = self._held()
        self._add(held, initialState)
        self._settle(held, self._now(timerValues))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        for batch in rows:
            self._add(held, batch)
        yield self._out(key, self._settle(held, self._now(timerValues)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._out(key, self._settle(self._held(), self._now(timerValues)))

    def close(self) -> None:
        pass


def live_sessions(
    exchanges: DataFrame,
    versions: int = EXCHANGE_MAX_VERSIONS,
    max_age_ms: int = HOUR_MS,
    lateness: str | None = None,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Whenever a session changes, its exchanges as they are then.

    With ``lateness`` time is the watermark that follows the exchanges' own time stamps by so much;
    without it, the clock.  ``stored`` is the table a first run begins with.
    """
    event_time = lateness is not None
    stream = exchanges.withWatermark("ts", lateness) if lateness is not None else exchanges
    return stream.groupBy("session").transformWithStateInPandas(
        AgingExchanges(versions, max_age_ms, event_time),
        outputStructType="session string, ts timestamp, exchange string",
        outputMode="update",
        timeMode="eventTime" if event_time else "processingTime",
        initialState=None if stored is None else stored.select("session", "ts", "exchange").groupBy("session"),
    )
