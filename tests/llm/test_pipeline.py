"""The pipeline's stages against what their operators decide, on the smallest tables."""

from __future__ import annotations

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import bpe, decontaminate, line_dedup, ngram_join, quality, queries
from docloom.llm.packing import pack_sorted
from docloom.session import configure

SF = "/root/testdata/sf0.001"


def ids(frame):
    return {r.doc_id for r in frame.select("doc_id").collect()}


def test_each_stage_takes_effect(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    stages = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == before.columns
        stages.append((before, docs))
    (given, good), (_, cut), (_, distinct), (_, clean), (_, encoded) = stages
    labels = queries.table(spark, SF, "labels")
    rejected = {r.doc_id for r in quality.Classifier(given, labels).scores().where("not kept").collect()}
    assert ids(good) == ids(given) - rejected and rejected
    assert ids(cut) == ids(line_dedup.drop_lines(good).where("not emptied"))
    assert ids(distinct) == {r.component_id for r in ngram_join.join_documents(cut, corpus_pipeline.NEAR).collect()}
    dirty = {r.doc_id for r in decontaminate.judge(distinct, queries.table(spark, SF, "benchmark")).where("contaminated").collect()}
    assert ids(clean) == ids(distinct) - dirty and dirty
    vocabulary = bpe.vocabulary(queries.vocabulary_path())
    for r in encoded.collect():
        found = np.frombuffer(bytes(r.token_ids), dtype="<u4")
        assert len(found) == r.n_tokens and vocabulary.decode(found).decode() == r.text
    assert ids(corpus_pipeline.run(spark, SF)) == ids(encoded)


def test_empty_and_odd_documents_pass_all_stages(spark):
    schema = queries.table(spark, SF, "documents").schema
    for rows in ([], [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[1:]:
            docs = stage(spark, docs, SF)
        assert docs.count() == len(rows)
        # no labelled document is among these, so the classifier has no evidence and rejects none
        unlabelled = queries.table(spark, SF, "labels").where("false")
        assert quality.Classifier(docs.limit(0), unlabelled).keep_good(docs).count() == len(rows)


def test_near_copies_go_and_others_stay(spark):
    """The pipeline's rule: runs of five words, at least 80 of 100 in common, by brute force."""
    words = [f"w{i}" for i in range(200)]
    changed = {n: words[:60] + [f"x{n}-{i}" for i in range(n)] + words[60 + n :] for n in (2, 9, 14, 18, 24, 40)}
    texts = [" ".join(words), *(" ".join(own) for own in changed.values())]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def runs(text):
        own = text.split()
        return {tuple(own[i : i + 5]) for i in range(len(own) - 4)}

    sets = [runs(text) for text in texts]
    linked = {
        (a, b)
        for a in range(len(sets))
        for b in range(a)
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    }
    reach = {i: i for i in range(len(sets))}
    for _ in sets:
        for a, b in linked:
            reach[a] = reach[b] = min(reach[a], reach[b])
    kept = ids(ngram_join.keep_first(frame, corpus_pipeline.NEAR))
    assert kept == {i for i, root in reach.items() if i == root} and 1 < len(kept) < len(texts)


def test_the_last_stage_decodes_what_it_encoded(spark):
    texts = ["plain words", "", None, "ünï <|endoftext|> 日本\r\n\t", "x" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs, SF).collect()}
    for k, text in enumerate(texts):
        assert got[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert set(got[0].asDict()) == {"doc_id", "text", "token_ids", "n_tokens", "decoded_sha256"}


def test_a_product_of_full_blocks_holds_few_copies_of_its_counts():
    """Two blocks of most classes have 16 MB of counts; a piece of them at a time is judged."""
    rule, draw = ngram_join.Rule(), np.random.default_rng(5)
    n = ngram_join.BLOCK
    sets = [np.unique(draw.integers(0, 4000, 40, dtype=np.uint64)) for _ in range(n)]
    sets += [np.unique(np.append(s[1:], 5000)) if i % 3 else draw.integers(6000, 9000, 40, dtype=np.uint64) for i, s in enumerate(sets)]
    sets = [np.unique(s) for s in sets]
    table = pa.table(
        {
            "first": pa.array([1] * 2 * n, pa.int64()),
            "second": pa.array([2] * 2 * n, pa.int64()),
            "block": pa.array([1] * n + [2] * n, pa.int64()),
            "class": pa.array(range(2 * n), pa.int64()),
            "grams": pa.array([pack_sorted(s) for s in sets], pa.binary()),
        }
    )
    tracemalloc.start()
    found = ngram_join._product(rule)(table).to_pydict()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = set(zip(found["a"], found["b"], strict=True))
    for i in range(0, n, 97):
        for j in range(n, 2 * n):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                assert (i, j) in got
    assert sum(b == a + n for a, b in got) == n - len(range(0, n, 3))
    assert most < 100e6


def test_encoding_holds_one_worker_a_task(spark):
    """Two Python steps in one task are two workers, each with the vocabulary and its cache."""
    docs = queries.table(spark, SF, "documents")
    encoded = corpus_pipeline.encode(spark, docs, SF)
    assert encoded._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    path = queries.vocabulary_path()
    apart = bpe.decode_ids(bpe.encode_texts(docs, path), path)
    wanted = {r.doc_id: (bytes(r.token_ids), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in apart.collect()}
    rows = encoded.collect()
    assert {r.doc_id: (bytes(r.token_ids), r.decoded_sha256) for r in rows} == wanted
    assert all(4 * r.n_tokens == len(r.token_ids) for r in rows)


def test_tasks_hand_bounded_bytes_to_python(spark):
    configure(spark)
    texts = spark.range(64, numPartitions=1).select(F.repeat(F.lit("word "), 200_000).alias("text"))

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n_bytes": [batch.nbytes]})

    sizes = [r.n_bytes for r in texts.mapInArrow(measure, "n_bytes long").collect()]
    assert sum(sizes) > 64_000_000 and max(sizes) <= 10_000_000
