import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import chunk, inference
from docloom.plans import ingestion


def brute_force(text, target, minimum, maximum):
    """The rules of the chunker, one step at a time."""
    words = text.split()
    limit = (maximum - target) // 2
    pieces, start = [], 0
    for i, word in enumerate(words):
        if word[-1] in ".?!" or i == len(words) - 1:
            pieces += [list(range(s, min(s + limit, i + 1))) for s in range(start, i + 1, limit)]
            start = i + 1
    groups = {}
    for piece in pieces:
        groups.setdefault(piece[0] // target, []).append(piece)
    chunks = list(groups.values())
    previous = [None] + [c[-1] for c in chunks[:-1]]
    spans = [((p or c[0])[0], c[0][0], c[-1][-1] + 1) for p, c in zip(previous, chunks, strict=True)]
    if len(spans) > 1:
        (lead, _, _), (_, own, end) = spans[-2], spans[-1]
        if end - own < minimum and end - lead <= maximum:
            spans = spans[:-2] + [(lead, spans[-2][1], end)]
    return [" ".join(words[lead:end]) for lead, _, end in spans]


def chunks_of(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", chunk.chunk_array(chunk.text_of(F.split("t", "\n")), **options).alias("c")).orderBy("i")
    return [r.c for r in rows.collect()]


WORD = st.sampled_from(["a", "bb", "c.", "d!", "e?", "é", "\n", "  "])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(WORD, max_size=120).map(" ".join), min_size=1, max_size=30))
def test_chunks_against_brute_force(spark, texts):
    options = {"target": 10, "minimum": 6, "maximum": 30}
    got = chunks_of(spark, texts, **options)
    for text, chunks in zip(texts, got, strict=True):
        assert chunks == (brute_force(text, **options) if text.split() else [])
        assert all(len(c.split(" ")) <= 30 for c in chunks)


def test_a_text_without_sentences_is_cut_at_words(spark):
    (chunks,) = chunks_of(spark, ["w " * 5000])
    assert max(len(c.split(" ")) for c in chunks) <= 2048
    (plain,) = chunks_of(spark, ["w " * 5000], overlap=False)
    assert sum(len(c.split(" ")) for c in plain) == 5000


def test_strategies(spark):
    types = ["text/plain", "application/pdf", "link/webp", "application/zip", None]
    df = spark.createDataFrame([(t,) for t in types], "t string")
    assert [r[0] for r in df.select(chunk.chunk_strategy(F.col("t"))).collect()] == ["text", "pdf", "image", None, None]


def test_embedder_gives_unit_vectors():
    vectors = inference.hashing_embedder(64)(["The cat, sat.", "the CAT sat", "", "dog"])
    assert np.allclose(vectors[0], vectors[1])
    assert np.allclose(np.linalg.norm(vectors, axis=1), [1, 1, 0, 1])


def test_embedder_remembers_words_from_call_to_call(monkeypatch):
    """A word is hashed once a worker, not once a call; forgetting changes no vector."""
    hashed = []
    monkeypatch.setattr(inference.hashlib, "md5", lambda word, md5=inference.hashlib.md5: hashed.append(word) or md5(word))
    embed, texts = inference.hashing_embedder(64), ["The cat, sat. é", "a  cat?!", "", "."]
    first = embed(texts)
    assert len(hashed) == 5 and np.array_equal(embed(texts), first) and len(hashed) == 5
    monkeypatch.setattr(inference, "SLOTS", 2)
    assert np.array_equal(inference.hashing_embedder(64)(texts), first)
    plain = np.zeros((4, 64))
    for row, words in enumerate([["the", "cat", "sat", "é"], ["a", "cat"], [], []]):
        for word in words:
            digest = hashlib.md5(word.encode()).hexdigest()
            plain[row, int(digest[:8], 16) % 64] += 1 if digest[8] < "8" else -1
    norms = np.sqrt((plain * plain).sum(axis=1, keepdims=True))
    assert np.array_equal(first, plain / np.where(norms > 0, norms, 1))


def test_a_failing_model_gives_error_rows(spark):
    def broken(texts):
        raise ValueError("no model")

    df = spark.createDataFrame([("k", "text")], "key string, chunk string")
    row = inference.embed_texts(df, "chunk", broken).first()
    assert row.embedding is None and row.embed_error == "ValueError: no model"

    links = spark.createDataFrame([("u", ["u"], "link/pdf")], "key string, content array<string>, type string")

    def broken_links(links, types):
        raise ValueError("no model")

    assert inference.chunk_links(links, broken_links).first().chunk_error == "ValueError: no model"
    prompts = spark.createDataFrame([("p",), (None,)], "summary_prompt string")
    got = inference.summarise(prompts, broken).orderBy(F.col("summary_prompt").desc_nulls_last()).collect()
    assert [r.summary_error for r in got] == ["ValueError: no model", None]


def test_one_bad_text_costs_its_own_row_and_long_texts_are_cut(spark):
    seen = inference.hashing_embedder(8)

    def picky(texts):
        if any("poison" in t or len(t.split()) > 5 for t in texts):
            raise ValueError("refused")
        return seen(texts)

    texts = spark.createDataFrame([("a", "one two"), ("b", "poison"), ("c", "w " * 9)], "key string, chunk string").coalesce(1)
    got = {r.key: r for r in inference.embed_texts(texts, "chunk", picky, max_tokens=5).collect()}
    assert got["a"].embed_error is None and len(got["a"].embedding) == 8
    assert got["b"].embed_error == "ValueError: refused" and got["b"].embedding is None
    assert got["c"].truncated and got["c"].token_count == 9 and got["c"].embed_error is None
    got = {r.key: r for r in inference.embed_texts(texts, "chunk", picky).collect()}
    assert not got["c"].truncated and got["c"].embed_error == "ValueError: refused"


def test_a_document_with_a_failed_chunk_is_withheld(spark):
    def picky(texts):
        if any("poison" in t for t in texts):
            raise ValueError("refused")
        return inference.hashing_embedder(8)(texts)

    contents = spark.createDataFrame(
        [("good", ["Fine words."], "text/plain", None), ("bad", ["Long line. " * 2000, "poison"], "text/plain", None)],
        "key string, content array<string>, type string, mime_type string",
    )
    rows, failed = ingestion.index_rows(contents, ingestion.Models(embed=picky))
    assert {r.doc_key for r in rows.collect()} == {"good"}
    assert {(r.key, r.stage) for r in failed.collect()} == {("bad", "embed")}


def test_the_newest_content_of_a_key_is_indexed(spark):
    contents = spark.createDataFrame(
        [("doc", ["aaa new."], 2), ("doc", ["zzz old."], 1)], "key string, content array<string>, second long"
    ).selectExpr(
        "key", "content", "'text/plain' AS type", "cast(null AS string) AS mime_type", "timestamp_seconds(second) AS ts"
    )
    rows, _ = ingestion.index_rows(contents, ingestion.Models(embed=inference.hashing_embedder(8)))
    assert [r.content for r in rows.collect()] == ["aaa new."]


def test_instances_of_all_kinds_go_through_one_stage(spark):
    rows = [
        (1, "TEXT", "a text", None), (2, "IMAGE_RAW", None, b"\x00\xff" * 3000), (3, "IMAGE_LINK", "gs://b/i.png", None),
        (4, "VIDEO_RAW", None, b"vv"), (5, "VIDEO_LINK", "gs://b/v.mp4", None), (6, "VIDEO_RAW", "no bytes", None),
        (7, "SOUND", "x", b"x"), (8, "TEXT", None, b"x"), (9, "TEXT", "bad", None), (10, None, "x", None),
    ]
    data = spark.createDataFrame(rows, "id int, kind string, text string, bytes binary").coalesce(1)

    def picky(instances):
        size = sum(len(i["text"] or "") + len((i["image"] or {}).get("bytesBase64Encoded") or "") for i in instances)
        assert len(instances) == 1 or size <= 100
        if any(i["text"] == "bad" for i in instances):
            raise ValueError("bad text")
        return inference.digest_instances(instances)

    got = {r.id: r for r in inference.embed_instances(data, picky, batch_bytes=100).collect()}
    assert {k for k, r in got.items() if r.embed_error is None} == {1, 2, 3, 4, 5}
    assert all(len(got[k].embedding) == 4 for k in (1, 2, 3, 4, 5)) and got[9].embedding is None
    assert got[9].embed_error == "ValueError: bad text" and got[7].embed_error == got[10].embed_error
    assert got[1].kind == "TEXT" and set(got[1].asDict()) == {"id", "kind", "embed_error", "embedding"}
    assert inference.embed_instances(data.limit(0), picky).count() == 0
    assert inference.embed_texts(spark.createDataFrame([("k", "one two three")], "key string, chunk string"), dimensions=5).first().token_count == 3


def test_texts_reach_the_embedder_in_calls_of_bounded_size(spark):
    """Each vector holds the rows and characters of its call."""
    embed = lambda texts: [[len(texts), sum(map(len, texts))]] * len(texts)
    rows = [(i, None if i % 50 == 1 else "x" * (3 << 20) if i in (5, 6, 7) else f"t {i}") for i in range(2000)]
    data = spark.createDataFrame(rows, "n int, chunk string").coalesce(1)
    got = inference.embed_texts(data, embed=embed).collect()
    assert sorted(r.n for r in got) == list(range(2000)) and all(r.embed_error is None for r in got)
    assert max(r.embedding[0] for r in got) <= inference.CALL_ROWS
    assert max(r.embedding[1] for r in got) <= inference.CALL_CHARACTERS
    assert inference.embed_texts(data.where("chunk IS NULL"), embed=embed).count() == 40
