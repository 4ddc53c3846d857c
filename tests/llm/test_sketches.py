"""Which classes of the n-gram join meet: sketches rule out pairs by what must differ, never a link."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa

from docloom.llm import ngram_join
from docloom.llm.words import mix

RULE = ngram_join.Rule(gram=5, percent=80)


def a_set(*numbers):
    return np.sort(mix(np.array([n for part in numbers for n in part], dtype=np.uint64)))


def sketches(sets):
    return ngram_join.Sketches([ngram_join.sketch(s) for s in sets], np.array([len(s) for s in sets]), RULE)


def test_sketches_never_rule_out_a_link():
    sets = [a_set(range(k, k + n)) for n in (1, 5, 60, 64, 65, 80, 127, 128, 129, 150, 1000, 1100, 2000) for k in (0, 1, 7, 13, 40, 200)]
    a, b = (np.array(x) for x in zip(*itertools.product(range(len(sets)), repeat=2), strict=True))
    possible = sketches(sets).may_link(a, b)
    linked = np.zeros(len(a), dtype=bool)
    for k, (i, j) in enumerate(zip(a, b, strict=True)):
        both = len(np.intersect1d(sets[i], sets[j]))
        linked[k] = 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)
    assert possible[linked].all() and linked.sum() > len(sets)
    assert possible.sum() < 2 * linked.sum()


def test_groups_that_lie_in_several_batches():
    """Group 1: a chain, a set far from it and a pair far from both; groups 2 and 3 are pairs."""
    sets = [a_set(range(k, k + 200)) for k in (0, 20, 40, 60)] + [a_set(range(900, 1100))] + [a_set(range(k, k + 150)) for k in (5000, 5004)]
    rows = [(1, c) for c in range(7)] + [(2, 3), (2, 5), (3, 5), (3, 6)]
    batch = pa.RecordBatch.from_pydict(
        {
            "group": [g for g, _ in rows],
            "class": [c for _, c in rows],
            "n_grams": [len(sets[c]) for _, c in rows],
            "sketch": [ngram_join.sketch(sets[c]) for _, c in rows],
        }
    )
    for step in (1, 2, 3, 8, 20):
        parts = [batch.slice(k, step) for k in range(0, len(rows), step)]
        edges = [tuple(e.values()) for out in ngram_join._possible_links(RULE)(iter(parts)) for e in out.to_pylist()]
        found = {frozenset(e) for e in edges}
        assert {e for e in found if max(e) < 4} == {frozenset(e) for e in ((0, 1), (1, 2), (2, 3))}
        assert {e for e in found if max(e) >= 4} == {frozenset((5, 6))}
    assert list(ngram_join._possible_links(RULE)(iter([batch.slice(0, 0)]))) == []


def test_all_classes_of_a_part_meet(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW_CLASSES", 4)
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", 8)
    own = {1: [1], 2: [1, 2, 3], 3: [1, 2], 4: list(range(10, 60)), 5: [2, 7, 40, 50]}
    incidence = spark.createDataFrame([(c, key) for key, classes in own.items() for c in classes], "class long, key long")
    members: dict[int, set[int]] = {}
    for r in ngram_join.groups(incidence).collect():
        members.setdefault(r.group, set()).add(r["class"])
    met = {p for group in members.values() for p in itertools.combinations(sorted(group), 2)}
    assert met == {p for classes in own.values() for p in itertools.combinations(classes, 2)}
    assert sum(group == {1, 2} for group in members.values()) == 1
    assert max(map(len, members.values())) < 50


def test_documents_with_a_common_phrase_are_not_sent_to_blocks(spark, monkeypatch):
    """By chance the phrase is a part of its own in many texts; only texts that are near are to meet as whole sets."""
    sized = []

    def recorded(classes, rule, places=ngram_join.places):
        sized.append(classes.count())
        return places(classes, rule)

    monkeypatch.setattr(ngram_join, "places", recorded)
    texts = [" ".join([f"w{k}-{i}" for i in range(60)] + ["one", "very", "common", "short", "phrase"]) for k in range(400)]
    near = [texts[k].replace(f"w{k}-0 ", f"x{k} ") for k in range(0, 400, 50)]
    frame = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    kept = {r.doc_id for r in ngram_join.keep_first(frame, RULE).select("doc_id").collect()}
    assert kept == set(range(400))
    assert sized == [2 * len(near)]
