import base64
import json

from pyspark.sql import functions as F

from docloom.operators import crawl, errors, extract, ingest
from docloom.sources import sinks
from docloom.sources.schemas import DOC_BODIES, FILES, MESSAGES, SHEET_BODIES, SLIDE_BODIES


def twice(text):
    return base64.b64encode(base64.b64encode(text.encode())).decode()


PAYLOADS = {
    "two members": json.dumps({"googleDrive": [{"urlOrId": "a"}], "rawData": {"id": "r", "data": "eA==", "mimeType": "text/plain"}}),
    "none": "{}",
    "unknown property": json.dumps({"rawData": {"id": "r", "data": twice("hé"), "mimeType": "text/plain"}, "z": 1}),
    "unknown mime": json.dumps({"references": [{"url": "u", "mimeType": "application/zip"}]}),
    "bad json": "{",
    "bad base64": json.dumps({"rawData": {"id": "r", "data": "%%", "mimeType": "text/plain"}}),
    "second unsupported": json.dumps(
        {"references": [{"url": "u1", "mimeType": "application/pdf"}, {"url": "u2", "mimeType": "text/plain"}, {"url": "u3", "mimeType": "image/png"}]}
    ),
}


def routed(spark):
    rows = [(None, p, {"name": n}) for n, p in PAYLOADS.items()]
    return ingest.route(ingest.parse_requests(spark.createDataFrame(rows, MESSAGES)))


def test_routing(spark):
    got = {r.attributes["name"]: r.route for r in routed(spark).collect()}
    assert got == {
        "two members": "drive",
        "none": "unsupported",
        "unknown property": "raw",
        "unknown mime": "malformed",
        "bad json": "malformed",
        "bad base64": "raw",
        "second unsupported": "references",
    }


def test_contents_and_failures(spark):
    r = routed(spark)
    raw, refs = ingest.raw_contents(r), ingest.reference_contents(r)
    whole = ingest.contents_of(raw).unionByName(ingest.contents_of(refs))
    assert sorted((x.key, x.content, x.type) for x in whole.collect()) == [
        ("r", ["hé"], "text/plain"),
        ("u1", ["u1"], "link/pdf"),
    ]
    failed = ingest.message_failures(r, raw, refs).collect()
    assert sorted(x.element for x in failed) == sorted(
        PAYLOADS[n] for n in ("none", "unknown mime", "bad json", "bad base64", "second unsupported")
    )


def test_metadata_entry_is_kept(spark):
    df = spark.createDataFrame([({"mime-type": "old"},), ({"a": "b"},), (None,)], "m map<string,string>")
    got = [r[0] for r in df.select(ingest.add_mime(F.col("m"), F.lit("new"), "mime-type")).collect()]
    assert got == [{"mime-type": "old"}, {"a": "b", "mime-type": "new"}, {"mime-type": "new"}]


P = "application/vnd.google-apps."


def tree(spark):
    rows = [
        ("root", "inner", "folder"), ("inner", "root", "folder"), ("empty", "root", "folder"),
        ("d1", "root", "document"), ("s1", "inner", "spreadsheet"), ("p1", "inner", "presentation"),
        ("v1", "inner", "video"),
    ]
    rows = [(i, parent, P + kind, None, f"[{i}] t", None) for i, parent, kind in rows]
    return spark.createDataFrame([*rows, ("odd", "inner", "x/y", None, "odd", None)], FILES)


def test_crawl_with_nested_and_empty_folders_and_a_cycle(spark):
    asked = ["root", "empty", "d1", "v1", "missing", "https://x.com/drive/u/0"]
    transports = spark.createDataFrame([(a, {"k": a}) for a in asked], "content_id string, metadata map<string,string>")
    got = crawl.expand(transports, tree(spark)).collect()
    found = sorted((r.content_id, r.id) for r in got if r.failure is None)
    assert found == [("d1", "d1"), ("root", "d1"), ("root", "p1"), ("root", "s1")]
    failed = sorted((r.content_id, r.id) for r in got if r.failure is not None)
    assert failed == [("https://x.com/drive/u/0", None), ("missing", "missing"), ("root", "odd")]
    documents = crawl.documents_of(crawl.expand(transports, tree(spark)))
    assert {r.metadata["mime-type"] for r in documents.filter("content_id = 's1'").collect()} == {P + "spreadsheet"}


def runs(*texts):
    return ([((t,),) for t in texts],)


def test_a_thousand_nested_folders_take_eleven_rounds(spark, monkeypatch):
    rounds = []
    keep = crawl.materialise
    monkeypatch.setattr(crawl, "materialise", lambda df, name="crawl": rounds.append(1) or keep(df, name))
    depth = 1000
    parents = [(f"d{k}", f"d{k - 1}") for k in range(1, depth)] + [("d0", f"d{depth - 1}"), ("e0", "d500"), ("e1", "e0"), ("x", "y")]
    frame = spark.createDataFrame(parents, "id string, up string")
    got = {tuple(r) for r in crawl.folders_below(spark.createDataFrame([("d400",), ("e0",), ("none",)], "root string"), frame).collect()}
    assert got == {("d400", f"d{k}") for k in range(depth)} | {("d400", "e0"), ("d400", "e1"), ("e0", "e0"), ("e0", "e1"), ("none", "none")}
    # the folders are written once, and each round writes its pairs and its steps
    assert (len(rounds) - 1 + 1) // 2 <= 11


def test_extraction_of_nested_bodies(spark):
    documents = spark.createDataFrame(
        [
            (
                "d1",
                [
                    (runs("Some random content ", "", "for test purposes.\n"), None),
                    (None, ([([([(runs("a"),), (None,), (runs("b\n"),)],)],)],)),
                    (runs(" ", "\n"), None),
                    (None, None),
                ],
            )
        ],
        DOC_BODIES,
    )
    sheets = spark.createDataFrame([("s1", [("one", [["a\nb", None, " "], ["c"]]), ("two", None)])], SHEET_BODIES)
    shape = (((([((("x\n",),)), ((None,),), ((" ",),)]),),),)
    slides = spark.createDataFrame([("p1", [([shape, (None,)],), (None,)])], SLIDE_BODIES)
    transports = spark.createDataFrame(
        [("d1", {"mime-type": P + "document"}), ("s1", {"mime-type": P + "spreadsheet"}), ("p1", {"mime-type": P + "presentation"}),
         ("v1", {"mime-type": P + "video"}), ("d2", {"mime-type": P + "document"})],
        "content_id string, metadata map<string,string>",
    )
    got = {r.content_id: r for r in extract.extract_contents(transports, tree(spark), documents, sheets, slides).collect()}
    assert got["d1"].content == ["Some random content  for test purposes.", "a  b"]
    assert got["d1"].key == "d1_t___d1"
    assert got["s1"].content == ["a b", "c"]
    assert got["p1"].content == ["x"]
    assert got["v1"].failure.startswith("Files of this type are not read")
    assert got["d2"].failure == "No such body"


def test_retries_are_counted_and_end(spark):
    failures = spark.createDataFrame(
        [("id", "a", {"retries": "100", "k": "v"}), ("content", "b", {"retries": "101"}), ("message", None, None), ("id", "c", None)],
        "stage string, content_id string, metadata map<string,string>",
    ).selectExpr("*", "content_id element", "'why' message", "timestamp'2024-01-01' ts")
    classified = errors.classify(failures)
    assert sorted((r.kind, r.content_id or "", r.retry_count) for r in classified.collect()) == [
        ("discardable", "", 0), ("discardable", "b", 101), ("retriable", "a", 101), ("retriable", "c", 1),
    ]
    sent = {r.payload: r.attributes for r in errors.retry_messages(classified).collect()}
    assert sent == {
        '{"googleDrive":[{"urlOrId":"a"}]}': {"k": "v", "retries": "101"},
        '{"googleDrive":[{"urlOrId":"c"}]}': {"retries": "1"},
    }
    again = ingest.route(ingest.parse_requests(errors.retry_messages(classified)))
    assert {r.route for r in again.collect()} == {"drive"}


def test_lines_of_many_documents_share_files_and_are_replaced_by_document(spark, tmp_path):
    folder, schema = str(tmp_path / "lines"), "key string, content array<string>"
    many = [(f"d{i}/ä", [f"line {i}", "two\nparts", ""]) for i in range(300)]
    sinks.write_content_lines(spark.createDataFrame(many, schema), folder)
    assert len([f for f in (tmp_path / "lines").rglob("part-*")]) <= 8
    sinks.write_content_lines(spark.createDataFrame([("d7/ä", ["new"]), ("d999", ["more"])], schema), folder)
    want = {(k, i, json.dumps({"text": line}, ensure_ascii=False, separators=(",", ":"))) for k, c in many if k != "d7/ä" for i, line in enumerate(c)}
    want |= {("d7/ä", 0, '{"text":"new"}'), ("d999", 0, '{"text":"more"}')}
    rows = sinks.read_content_lines(spark, folder).collect()
    assert {(r.key, r.pos, r.value) for r in rows} == want and len(rows) == len(want)
