import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import ivf, search


def tables(spark, n=300, q=40, d=8, seed=1):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-3, 4, size=(n, d)).astype(float)  # small integers give many ties
    vectors[5:6] = 0.0
    queries = rng.integers(-3, 4, size=(q, d)).astype(float)
    v = spark.createDataFrame([(f"v{i}", x.tolist()) for i, x in enumerate(vectors)], "id string, embedding array<float>")
    qs = spark.createDataFrame(
        [(i, f"q{i}", x.tolist(), 1 + i % 4) for i, x in enumerate(queries)],
        "query_pos long, query_id string, embedding array<float>, max_nn int",
    )
    return v, qs, vectors, queries


def brute_force(vectors, queries, metric):
    want = set()
    for i, q in enumerate(queries):
        scores = []
        for j, v in enumerate(vectors):
            s = float(q @ v)
            if metric == "cosine":
                norm = np.linalg.norm(q) * np.linalg.norm(v)
                s = s / norm if norm else 0.0
            scores.append((-round(s, 9), f"v{j}"))
        want |= {(i, name, rank + 1) for rank, (_, name) in enumerate(sorted(scores)[: 1 + i % 4])}
    return want


def found(hits):
    return {(r.query_pos, r.id, r.rank) for r in hits.collect()}


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_exact_search_against_brute_force(spark, metric):
    v, q, vectors, queries = tables(spark)
    want = brute_force(vectors, queries, metric)
    assert found(search.exact(q, v, metric)) == want
    assert found(search.exact(q, v, metric, broadcast_bytes=0)) == want


def test_blocks_smaller_than_the_tables(spark, monkeypatch):
    v, q, vectors, queries = tables(spark)
    monkeypatch.setattr(search, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    assert found(search.exact(q, v, broadcast_bytes=0)) == brute_force(vectors, queries, "cosine")


def test_fewer_vectors_than_wanted_and_a_bound(spark):
    v, q, *_ = tables(spark, n=2)
    assert search.exact(q, v).groupBy("query_pos").count().agg(F.max("count")).first()[0] == 2
    assert search.exact(q, v, min_score=1.0).count() == 0


def test_ivf_with_one_hot_leaf(spark, monkeypatch):
    v, q, vectors, queries = tables(spark)
    monkeypatch.setattr(search, "VECTOR_BLOCK", 50)
    leaves = spark.createDataFrame([(0, [1.0] * 8), (1, [-9.0] + [1.0] * 7)], "leaf int, centre array<double>")
    assigned = ivf.assign(v, leaves).withColumn("leaf", F.lit(0))
    got = search.VectorIndex(assigned, mode="ivf", leaves=leaves, probe_fraction=1.0).find(q)
    assert found(got) == brute_force(vectors, queries, "cosine")
    blocks = ivf.search(q, assigned, leaves, probe_fraction=1.0, broadcast_bytes=0)
    assert found(blocks) == brute_force(vectors, queries, "cosine")


def test_ivf_looks_into_the_nearest_leaves_only(spark):
    v, q, *_ = tables(spark)
    leaves = ivf.train(v, per_leaf=30)
    assigned = ivf.assign(v, leaves)
    shared = ivf.search(q, assigned, leaves, probe_fraction=0.2)
    assert found(shared) == found(ivf.search(q, assigned, leaves, probe_fraction=0.2, broadcast_bytes=0))


def test_ivf_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 5
    points = np.concatenate([c + rng.normal(size=(30, 16)) for c in centres])
    v = spark.createDataFrame([(f"v{i}", x.tolist()) for i, x in enumerate(points)], "id string, embedding array<float>")
    q = search.query_batch(v.withColumn("n", F.expr("cast(substr(id, 2) as int)")), F.col("n"), 3)
    leaves = ivf.train(v, per_leaf=30)
    assigned = ivf.assign(v, leaves)
    assert leaves.count() == 20 and assigned.count() == 600
    report = ivf.recall(ivf.search(q, assigned, leaves), search.exact(q, v)).first()
    assert report.wanted == 1800 and report.recall > 0.9


def test_probe_share_reaches_the_recall_on_vectors_without_clusters(spark):
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(f"v{i}", x.tolist()) for i, x in enumerate(rng.normal(size=(600, 16)))], "id string, embedding array<float>")
    q = search.query_batch(v.withColumn("n", F.expr("cast(substr(id, 2) as int)")), F.col("n"), 3)
    leaves = ivf.train(v, per_leaf=30)
    assigned, truth = ivf.assign(v, leaves), search.exact(q, v)
    share = ivf.probe_share(q, assigned, leaves)
    assert ivf.recall(ivf.search(q, assigned, leaves), truth).first().recall < 0.9
    assert 0.1 < share < 1.0
    assert ivf.recall(ivf.search(q, assigned, leaves, probe_fraction=share), truth).first().recall >= 0.9


def test_registered_search_reaches_the_recall(spark):
    from docloom.catalog import QUERIES

    truth, hits = (QUERIES[name](spark, "/root/testdata/sf0.01") for name in ("G02_exact_search", "G04_ivf_search"))
    assert ivf.recall(hits, truth).first().recall >= 0.9


def test_more_neighbours_than_the_probed_leaves_hold(spark):
    v, q, *_ = tables(spark, n=60, q=5)
    leaves = ivf.train(v, per_leaf=6)
    assigned = ivf.assign(v, leaves)
    many = q.withColumn("max_nn", F.when(F.col("query_pos") == 0, 200).otherwise(25))
    for broadcast_bytes in (search.BROADCAST_BYTES, 0):
        hits = ivf.search(many, assigned, leaves, broadcast_bytes=broadcast_bytes)
        assert sorted(r["count"] for r in hits.groupBy("query_pos").count().collect()) == [25, 25, 25, 25, 60]


def test_configuration_is_checked(spark):
    v, q, *_ = tables(spark, n=5, q=5)
    with pytest.raises(ValueError):
        search.VectorIndex(v, metric="l2")
    with pytest.raises(ValueError):
        search.VectorIndex(v, mode="ivf")
    with pytest.raises(ValueError):
        search.VectorIndex(v, mode="tree")


def test_seed_vector_is_never_found(spark):
    v = spark.createDataFrame([("dummy", [1.0, 0.0]), ("a", [0.0, 1.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([(0, "q", [1.0, 0.0], 3)], "query_pos long, query_id string, embedding array<float>, max_nn int")
    assert [r.id for r in search.VectorIndex(v).find(q).collect()] == ["a"]


def test_many_queries_meet_the_leaves_without_a_shuffle_of_vectors(spark):
    v, q, *_ = tables(spark)
    leaves = ivf.train(v, per_leaf=30)
    hits = ivf.search(q, ivf.assign(v, leaves), leaves, probe_fraction=1.0, broadcast_bytes=0)
    assert "FlatMapCoGroups" not in hits._jdf.queryExecution().toString()
    assert found(hits) == found(search.exact(q, v))


def test_a_sample_gives_the_centres_and_every_vector_has_a_leaf(spark, monkeypatch):
    v, q, *_ = tables(spark, n=900)
    monkeypatch.setattr(ivf, "TRAINING_ROWS", 200)
    leaves = ivf.train(v, per_leaf=30)
    assigned = ivf.assign(v, leaves)
    assert assigned.count() == 900
    assert found(ivf.search(q, assigned, leaves, probe_fraction=1.0)) == found(search.exact(q, v))


def test_best_of_blocks_with_ties_and_scores_that_are_none():
    from docloom.operators.blocks import Best

    rng = np.random.default_rng(7)
    scores = rng.integers(0, 4, size=(30, 500)) / 3.0
    scores[:, ::50] = np.nan
    ids = np.array([f"v{i:03d}" for i in rng.permutation(500)], dtype=object)
    best = Best(3, None)
    for start in range(0, 500, 100):
        own = np.sort(ids[start : start + 100])
        columns = [list(ids).index(i) for i in own]
        best.add(scores[:, columns], np.arange(30), own)
    got = {(int(q), i, s) for q, i, s in zip(*best.rows(), strict=True)}
    want = set()
    for row in range(30):
        order = sorted((-round(s, 9), i) for s, i in zip(scores[row], ids, strict=True) if s == s)
        want |= {(row, i, -s) for s, i in order[:3]}
    assert got == want


def test_registered_searches_ask_for_every_twentieth_id(spark):
    from docloom.catalog import QUERIES

    asked = QUERIES["G02_exact_search"](spark, "/root/testdata/sf0.001").select("query_pos").distinct().collect()
    assert asked and all(r.query_pos % 20 == 0 for r in asked)
