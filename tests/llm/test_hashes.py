"""Texts that a polynomial hash modulo 2**64 confuses, through the operators that compare by hash."""

from __future__ import annotations

import pytest

from docloom.llm import ngram_join, substring_dedup


def thue_morse(length: int, a: str, b: str) -> str:
    return "".join(b if bin(i).count("1") % 2 else a for i in range(length))


@pytest.mark.parametrize("size", [1024, 4096])
def test_confusable_words_are_different(spark, size):
    first, second = thue_morse(size, "a", "b"), thue_morse(size, "b", "a")
    common = " ".join(f"w{k}" for k in range(12))
    rows = [(1, first), (2, second), (3, f"{common} {first}"), (4, f"{common} {second}"), (5, thue_morse(size, "x ", "y ")), (6, thue_morse(size, "y ", "x "))]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = {r.doc_id: r.component_id for r in ngram_join.join_documents(documents).collect()}
    # 3 and 4 share 9 of 11 shingles; 5 and 6 have the same few
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}
    cut = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(documents).collect()}
    assert [cut[k] for k in (1, 2, 3, 4, 5)] == [0] * 5 and 0 < cut[6] <= size


def test_copies_near_copies_and_rows_without_id(spark):
    base = [f"w{k}" for k in range(300)]
    near = " ".join([*base[:100], "changed", *base[101:]])
    rows = [(k, " ".join(base)) for k in (9, 4, 7, 4)] + [(2, near), (3, near), (None, near), (None, " ".join(base)), (1, "other words")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in ngram_join.join_documents(documents).collect())
    assert found == [(-1, 2), (-1, 2), (1, 1), (2, 2), (3, 2), (4, 2), (4, 2), (7, 2), (9, 2)]
    cut = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in substring_dedup.remove_repeats(documents).collect())
    # of 300 words all but the changed one stand in windows of document 2
    assert cut == [(-1, 0), (-1, 0), (1, 0), (2, 0), (3, 300), (4, 299), (4, 299), (7, 300), (9, 300)]
