import datetime as dt
import json

from pyspark.sql import functions as F

from docloom.operators import errors
from docloom.plans import ingestion
from docloom.sources import messages, sinks
from docloom.sources.schemas import DOC_BODIES, FILES, MESSAGES, SHEET_BODIES, SLIDE_BODIES
from docloom.streaming import jobs

AT = dt.datetime(2024, 1, 1)
P = "application/vnd.google-apps."


def file_store(spark, lines):
    files = [("f1", None, P + "document", None, "One", None), ("f2", None, P + "sheet", None, "Two", None)]
    body = [(([((line,),)],), None) for line in lines]
    return ingestion.FileStore(
        spark.createDataFrame(files, FILES),
        spark.createDataFrame([("f1", body)], DOC_BODIES),
        spark.createDataFrame([], SHEET_BODIES),
        spark.createDataFrame([], SLIDE_BODIES),
    )


def request(*ids):
    return json.dumps({"googleDrive": [{"urlOrId": i} for i in ids]})


def test_ingestion_stream_replaces_a_shrunk_document(spark, tmp_path):
    inbox, retry, wrong = (str(tmp_path / n) for n in ("inbox", "retry", "errors"))
    store, now = ingestion.open_store(spark, str(tmp_path / "store")), F.lit(AT)
    sentence = "word " * 399 + "end."
    long_store = file_store(spark, [sentence] * 4)
    first = spark.createDataFrame([(AT, request("f1"), {})], MESSAGES)
    result = ingestion.ingest_messages(first, long_store)
    ingestion.store_rows(result.rows, store, now)
    before = {r.id for r in store.table("vectors").collect()}
    assert len(before) == 4 and all(k.startswith("one___f1___") for k in before)

    sent = [
        (AT, request("f1"), {}),
        (AT, request("f2", "f9"), {"retries": "3"}),
        (AT, json.dumps({"references": [{"url": "https://x/a.pdf", "mimeType": "application/pdf"}]}), {}),
        (AT, "{", {}),
    ]
    messages.publish(spark.createDataFrame(sent, MESSAGES), inbox)
    handle = jobs.ingestion_handler(file_store(spark, [sentence]), store, wrong, retry, lines_folder=str(tmp_path / "lines"))
    jobs.start_ingestion(messages.stream_messages(spark, inbox), handle, str(tmp_path / "cp"), availableNow=True).awaitTermination(120)

    assert {r.id for r in store.table("vectors").collect()} == {"one___f1___0", "https://x/a.pdf___0"}
    cells = ingestion.stored_cells(store.snapshot())
    links = cells.filter("qualifier = 'link'")
    assert {(r.row_key, r.value) for r in links.collect()} == {
        ("one___f1___0", "https://docs.google.com/document/d/f1"), ("https://x/a.pdf___0", "https://x/a.pdf"),
    }
    versions = cells.filter("row_key = 'one___f1___0' AND qualifier = 'content'")
    assert versions.count() == 2
    again = messages.read_messages(spark, retry).collect()
    assert {(r.payload, r.attributes["retries"]) for r in again} == {
        ('{"googleDrive":[{"urlOrId":"f2"}]}', "4"), ('{"googleDrive":[{"urlOrId":"f9"}]}', "4"),
    }
    assert {r.element for r in sinks.read_errors(spark, wrong).collect()} == {"{"}
    assert spark.read.text(str(tmp_path / "lines")).count() == 2


def test_held_retries_come_out_when_their_window_closes(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    early = [(AT + dt.timedelta(minutes=m), f"p{m}", {"retries": str(m)}) for m in (0, 3, 9)] + [(AT, "p0", {"retries": "0"})]
    later = [(AT + dt.timedelta(minutes=25), "p25", {}), (AT + dt.timedelta(minutes=26), "p26", {})]
    for rows in (early, later):
        messages.publish(spark.createDataFrame(rows, MESSAGES).coalesce(1), folder)
    stream = errors.hold_retries(messages.stream_messages(spark, folder, 1))
    jobs.append_to(stream, out, str(tmp_path / "cp"), availableNow=True).awaitTermination(120)
    got = spark.read.parquet(out)
    batch = errors.hold_retries(spark.createDataFrame(early, MESSAGES))
    key = lambda df: sorted((r.released_at, r.ts, r.payload, str(r.attributes)) for r in df.collect())
    assert key(got) == key(batch) and got.count() == 4


def test_ids_are_deduplicated_within_the_window(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a", AT), ("a", AT + dt.timedelta(seconds=20)), ("b", AT)]
    spark.createDataFrame(rows, "id string, ts timestamp").write.parquet(folder)
    stream = jobs.deduplicate(spark.readStream.schema("id string, ts timestamp").parquet(folder))
    jobs.append_to(stream, out, str(tmp_path / "cp"), availableNow=True).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b"]
