"""Tables that Spark sizes too low are not broadcast, however small they look."""

from docloom.llm import line_dedup, ngram_join


def documents(spark):
    lines = [f"the line number {i} of this text is long enough to have neighbours" for i in range(40)]
    texts = ["\n".join([line, line[:-1] + "z", line.upper()]) for line in lines]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_broadcasts_neither_variants_nor_texts(spark):
    docs = documents(spark)
    near = line_dedup.near_lines(line_dedup.keyed(docs).select("doc_id", "text_hash", "text"))
    assert "SortMergeJoin" in plan(near) and "Broadcast" not in plan(near)
    dropped = line_dedup.drop_lines(docs)
    assert [line for line in plan(dropped).splitlines() if "SortMergeJoin" in line and "LeftOuter" in line]
    assert sorted((r.doc_id, r.n_lines, r.n_removed_lines) for r in dropped.collect())[0] == (0, 3, 1)



def test_ngram_join_broadcasts_no_table_of_pairs(spark):
    incidence = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 11), (4, 12)], "class long, key long")
    assert "Broadcast" not in plan(ngram_join.groups(incidence))
    facts = spark.createDataFrame(
        [(i, i, 4, i, bytearray(ngram_join.sketch(ngram_join.np.arange(4, dtype="u8")))) for i in range(1, 5)],
        "doc_id long, text_hash long, n_shingles long, class long, sketch binary",
    )
    possible = ngram_join.possible_links(incidence, facts, ngram_join.Rule())
    assert "Broadcast" not in plan(possible)
    assert {tuple(sorted(r)) for r in possible.collect()} == {(1, 2), (2, 3)}
