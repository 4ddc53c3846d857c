"""State that the clock acts on, in streams of several batches."""

import datetime as dt
import time

from pyspark.sql import functions as F

from docloom.operators import index
from docloom.sources import messages
from docloom.sources.schemas import MESSAGES
from docloom.streaming import jobs, state

AT = dt.datetime(2024, 1, 1, 10)
EXCHANGES = "session string, ts timestamp, exchange string"


def wait_for(condition, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if condition():
            return True
        time.sleep(0.5)
    return False


def test_a_lone_retry_is_released_by_the_clock(spark, tmp_path):
    """Nothing arrives after it, and no watermark moves."""
    retry, inbox = str(tmp_path / "retry"), str(tmp_path / "inbox")
    now = spark.range(1).select(F.current_timestamp().alias("ts"))
    soon = now.select("ts", F.lit("soon").alias("payload"), F.create_map(F.lit("retries"), F.lit("1")).alias("attributes"))
    old = spark.createDataFrame([(AT, "old", {"retries": "7"})], MESSAGES)
    messages.publish(soon.unionByName(old), retry)
    window = 8
    run = jobs.start_requeue(
        messages.stream_messages(spark, retry), inbox, str(tmp_path / "cp"), f"{window} seconds", processingTime="1 second"
    )
    try:
        released = lambda: {r.payload: r for r in messages.read_messages(spark, inbox).collect()} if (tmp_path / "inbox").exists() else {}
        assert wait_for(lambda: "old" in released())
        assert wait_for(lambda: "soon" in released())
        got = released()
        assert got["soon"].attributes == {"retries": "1"} and got["old"].attributes == {"retries": "7"}
        ends = got["soon"].ts.replace(tzinfo=dt.timezone.utc).timestamp() // window * window + window
        written = max(f.stat().st_mtime for f in (tmp_path / "inbox").rglob("*.json") if "soon" in f.read_text())
        assert written >= ends - 0.5
        time.sleep(2)
        assert messages.read_messages(spark, inbox).count() == 2
    finally:
        run.stop()


def test_exchanges_of_a_session_age_one_by_one(spark, tmp_path):
    """Three batches against the table form of retention, with the watermark as the time."""
    minute = lambda m: AT + dt.timedelta(minutes=m)
    stored = spark.createDataFrame([("a", minute(-30), "stored"), ("z", minute(-70), "gone"), ("z", minute(-10), "z")], EXCHANGES)
    batches = [
        [("a", minute(0), "first"), ("b", minute(1), "b")],
        [("a", minute(50), f"more {k}") for k in range(2)],
        [("c", minute(65), "c"), ("a", minute(65), "newest")],
    ]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], EXCHANGES).write.parquet(folder)
    got = {}
    for rows in batches:
        spark.createDataFrame(rows, EXCHANGES).coalesce(1).write.mode("append").parquet(folder)
        stream = state.live_sessions(spark.readStream.schema(EXCHANGES).parquet(folder), lateness="0 seconds", stored=stored)
        with state.rocksdb(spark):
            run = jobs.each_batch(
                stream, lambda df, b: df.withColumn("batch", F.lit(b.number)).write.mode("append").parquet(out), str(tmp_path / "cp"), availableNow=True
            )
            run.awaitTermination(180)
    for row in spark.read.parquet(out).collect():
        got.setdefault(row.session, {}).setdefault(row.batch, []).append((row.ts, row.exchange))
    last = {s: sorted(x for x in by[max(by)] if x[1] is not None) for s, by in got.items()}
    whole = stored.unionByName(spark.createDataFrame([r for b in batches for r in b], EXCHANGES))
    kept = index.keep_exchanges(whole, F.lit(minute(65))).collect()
    expected = {s: sorted((r.ts, r.exchange) for r in kept if r.session == s) for s in "abcz"}
    assert {s: last.get(s) for s in "abc"} == {s: expected[s] for s in "abc"}
    assert [x for _, x in expected["a"]] == ["more 0", "more 1", "newest"] and expected["b"] == []


def test_no_more_than_the_newest_versions_are_held(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = [("s", now - dt.timedelta(minutes=k), f"x{k}") for k in (1, 2, 3, 4, 5, 6, 7, 61, 90)]
    spark.createDataFrame(rows, EXCHANGES).repartition(3).write.parquet(folder)
    with state.rocksdb(spark):
        run = jobs.each_batch(
            state.live_sessions(spark.readStream.schema(EXCHANGES).parquet(folder)),
            lambda df, _: df.write.mode("append").parquet(out), str(tmp_path / "cp"), once=True,
        )
        run.awaitTermination(180)
    assert sorted(r.exchange for r in spark.read.parquet(out).collect()) == ["x1", "x2", "x3", "x4", "x5"]


def test_ids_per_window_dont_depend_on_the_batches(spark, tmp_path):
    rows = [(f"u{k % 3}", AT + dt.timedelta(seconds=7 * k)) for k in range(60)]
    expected = sorted({(i, t.replace(second=0)) for i, t in rows})
    for parts in (1, 5):
        folder, out = str(tmp_path / f"in{parts}"), str(tmp_path / f"out{parts}")
        size = len(rows) // parts
        spark.createDataFrame([], "id string, ts timestamp").write.parquet(folder)
        stream = jobs.ids_per_window(spark.readStream.schema("id string, ts timestamp").parquet(folder))
        for k in range(parts):
            spark.createDataFrame(rows[k * size : (k + 1) * size], "id string, ts timestamp").write.mode("append").parquet(folder)
            jobs.run_available(stream, out, str(tmp_path / f"cp{parts}"))
        assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == expected


def test_a_repeated_batch_adds_no_error_retry_or_message(spark, tmp_path):
    from docloom.plans import ingestion
    from docloom.sources import sinks
    from tests.test_streaming import file_store, request

    store = ingestion.open_store(spark, str(tmp_path / "store"))
    wrong, retry = str(tmp_path / "errors"), str(tmp_path / "retry")
    handle = jobs.ingestion_handler(file_store(spark, ["a line."]), store, wrong, retry)
    rows = spark.createDataFrame([(AT, request("f1", "f9"), {}), (AT, "{", {})], MESSAGES)
    for number in (0, 0, 1, 1, 0):
        handle(rows, jobs.Batch("q", number))
    assert sinks.read_errors(spark, wrong).count() == 2 and messages.read_messages(spark, retry).count() == 2
    assert store.snapshot().manifest.version == 2 and store.table("vectors").count() == 1
    assert ingestion.stored_cells(store.snapshot()).where("qualifier = 'content'").count() == 2
