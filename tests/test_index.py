import datetime as dt

from pyspark.sql import functions as F

from docloom.operators import admin, index
from docloom.sources import stores


def rows(spark, keys):
    return spark.createDataFrame([(k, f"text {k}", [float(len(k))]) for k in keys], "row_key string, content string, embedding array<float>")


def names(df, column="row_key"):
    return sorted(r[0] for r in df.select(column).collect())


def test_a_shrunk_document_leaves_stale_keys_and_its_siblings_alone(spark):
    old = rows(spark, [f"t___doc1___{i}" for i in range(12)] + ["t___doc10___0", "u___1", "u___10"])
    new = rows(spark, [f"t___doc1___{i}" for i in range(3)])
    stale = index.stale_keys(old, new)
    assert names(stale) == sorted(f"t___doc1___{i}" for i in range(3, 12))
    vectors = old.select(F.col("row_key").alias("id"), "embedding")
    after = index.replace_vectors(vectors, new)
    assert names(after, "id") == sorted([f"t___doc1___{i}" for i in range(3)] + ["t___doc10___0", "u___1", "u___10"])
    ops = index.change_set(old, new).groupBy("op").count().collect()
    assert {r["op"]: r["count"] for r in ops} == {"DELETE": 9, "UPSERT": 3}


def test_a_renamed_file_takes_its_old_keys_along(spark):
    old = rows(spark, ["old___f1___0", "old___f1___1", "other___f2___0"])
    assert names(index.stale_keys(old, rows(spark, ["new___f1___0"]))) == ["old___f1___0", "old___f1___1"]


def test_titles_with_separators_keep_to_their_own_rows(spark):
    old = rows(spark, ["a___b___f1___0", "a___b___f1___1", "a___c___f2___0", "a___d___0"])
    new = rows(spark, ["a___b___f1___0"])
    assert names(index.stale_keys(old, new)) == ["a___b___f1___1"]
    after = index.replace_vectors(old.select(F.col("row_key").alias("id"), "embedding"), new)
    assert names(after, "id") == ["a___b___f1___0", "a___c___f2___0", "a___d___0"]


def test_upsert_replaces_inserts_and_takes_one_of_several(spark):
    old = spark.createDataFrame([("a", [1.0]), ("b", [1.0])], "id string, embedding array<float>")
    new = spark.createDataFrame([("b", [2.0]), ("c", [3.0]), ("c", [4.0])], "id string, embedding array<float>")
    got = sorted((r.id, r.embedding) for r in index.upsert_vectors(old, new).collect())
    assert got == [("a", [1.0]), ("b", [2.0]), ("c", [4.0])]
    timed = new.selectExpr("id", "embedding", "timestamp_seconds(9 - embedding[0]) AS ts")
    assert {(r.id, r.embedding[0]) for r in index.latest_vectors(timed).collect()} == {("b", 2.0), ("c", 3.0)}


def test_versions_and_latest(spark):
    at = dt.datetime(2024, 1, 1)
    cells = spark.createDataFrame(
        [("k", "content", at + dt.timedelta(hours=h), f"v{h}") for h in range(8)] + [("k2", "link", at, "l")],
        "row_key string, qualifier string, ts timestamp, value string",
    )
    kept = index.keep_versions(cells)
    assert names(kept.filter("row_key = 'k'"), "value") == ["v3", "v4", "v5", "v6", "v7"]
    wanted = spark.createDataFrame([("k",), ("k2",), ("none",)], "row_key string")
    got = {r.row_key: (r.content, r.link) for r in stores.content_by_key(cells, wanted).collect()}
    assert got == {"k": ("v7", ""), "k2": ("", "l"), "none": ("", "")}


def test_exchanges_expire_by_age_and_by_count(spark):
    now = dt.datetime(2024, 1, 1, 12)
    rows_ = [("s", now - dt.timedelta(minutes=10 * m), f"q{m}___a") for m in range(9)] + [("  ", now, "q___a")]
    stored = spark.createDataFrame(rows_, "session string, ts timestamp, exchange string")
    kept = index.keep_exchanges(stored.filter("session = 's'"), F.lit(now))
    assert names(kept, "exchange") == [f"q{m}___a" for m in range(5)]
    kept = index.keep_exchanges(stored.filter("session = 's'"), F.lit(now), "25 minutes")
    assert names(kept, "exchange") == ["q0___a", "q1___a", "q2___a"]
    assert stores.session_exchanges(stored, stored.select("session")).count() == 9
    answered = spark.createDataFrame([("s", "q", "a"), (" ", "q", "a")], "session string, question string, answer string")
    assert index.append_exchanges(stored, answered, F.lit(now)).count() == 11
    assert index.delete_sessions(stored, stored.filter("session = 's'")).count() == 1


def test_links(spark):
    files = spark.createDataFrame(
        [("f1", "application/vnd.google-apps.document"), ("f2", "application/vnd.google-apps.video")], "id string, mime_type string"
    )
    got = {r.row_key: r.link for r in index.with_links(rows(spark, ["t___f1___0", "t___f2___0", "t___f3___0", "u___0"]), files).collect()}
    assert got == {
        "t___f1___0": "https://docs.google.com/document/d/f1", "t___f2___0": "NA f2", "t___f3___0": "NA f3", "u___0": "u",
    }


def test_only_files_changed_in_the_period_are_refreshed(spark):
    now = dt.datetime(2024, 1, 1, 12)
    hours = lambda h: now - dt.timedelta(hours=h)
    files = spark.createDataFrame(
        [("f1", "d", hours(5), "l1"), ("f2", "d", hours(7), "l2"), ("f3", "d", hours(1), "l3"), ("f4", "d", hours(1), None)],
        "id string, mime_type string, modified_time timestamp, web_view_link string",
    )
    content = rows(spark, ["t___f1___0", "t___f1___1", "t___f2___0", "t___f4___0", "f3___0"])
    assert names(index.refresh_requests(content, files, F.lit(now)), "payload") == ['{"googleDrive":[{"urlOrId":"l1"}]}']


def test_buckets_emptied_and_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    index.write_bucketed(rows(spark, [f"k{i}___0" for i in range(40)]).select("row_key"), path, buckets=4)
    gone = rows(spark, [f"k{i}___0" for i in range(40)])
    index.rewrite_buckets(spark, path, gone, lambda old: old.filter("row_key = 'k7___0'"))
    assert names(spark.read.parquet(path)) == ["k7___0"]
    index.write_bucketed(rows(spark, ["k1___0"]).select("row_key"), path, buckets=9)
    assert names(spark.read.parquet(path)) == ["k1___0"] and index.bucket_count(spark, path) == 9


def test_admin(spark):
    content = rows(spark, ["t___f1___0", "t___f1___1", "t___f2___0", "u___0"])
    assert sorted(tuple(r) for r in admin.list_documents(content).collect()) == [("t", "f1"), ("t", "f2")]
    vectors = content.select(F.col("row_key").alias("id"), "embedding")
    gone = spark.createDataFrame([("t", "f1")], "name string, drive_id string")
    left = admin.delete_documents(vectors, content, gone)
    assert names(left[0], "id") == names(left[1]) == ["t___f2___0", "u___0"]
