from pyspark.sql import functions as F

from docloom.functions.html import page_text
from docloom.operators import chunk
from docloom.plans import ingestion


def test_text_of_pages(spark):
    pages = {
        "<p>one <b>two</b></p><!-- <p>no</p> --><SCRIPT>var a = '</p>';</SCRIPT><p >three<br/>four": "one two\nthree\nfour",
        "a &amp;lt; b &lt;i&gt; &quot;c&quot;&nbsp;d": 'a &lt; b <i> "c" d',
        "<style>p{}</style><ul><li>x<li> y  z </ul>": "x\ny z",
        "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
        "": "",
        "<p>" * 3000 + "deep": "deep",
        "<!DOCTYPE html><html><head><title>T</title></head><body>plain\ntext</body></html>": "T\nplain\ntext",
    }
    rows = spark.createDataFrame([*pages.items(), (None, None)], "html string, want string")
    assert [r for r in rows.select("html", "want", page_text(F.col("html")).alias("got")).collect() if r.got != r.want] == []


def test_links_are_read_from_pages_and_others_are_tried_again(spark):
    pages = spark.createDataFrame([("u1", "<p>A page.</p>"), ("u2", None), ("u3", "<br>")], "url string, html string")
    contents = spark.createDataFrame([(u, [u], "link/pdf") for u in ("u1", "u2", "u3", "u4")], "key string, content array<string>, type string")
    rows, failed = ingestion.index_rows(contents.withColumn("mime_type", F.lit(None).cast("string")), ingestion.Models(pages=pages))
    assert [(r.row_key, r.content) for r in rows.collect()] == [("u1___0", "A page.")]
    found = {r.key: r for r in failed.collect()}
    assert {(k, r.stage, r.failure) for k, r in found.items()} == {(u, "chunk", f"The link was not read: {u}") for u in ("u2", "u4")}
    assert found["u4"].request == '{"references":[{"url":"u4","mimeType":"application/pdf"}]}'
    assert chunk.chunk_pages(contents.limit(0), pages).count() == 0
