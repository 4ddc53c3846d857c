"""The registered searches ask with every vector, on rows of their own."""

import duckdb
import pytest

from docloom.catalog import QUERIES, SQL
from tests.compare import difference, rows_of_spark, rows_of_sql

SEARCHES = [
    "G02_exact_search", "G02_exact_search_blocks", "G03_dot_product_search", "G04_ivf_search_all_leaves",
    "G04_ivf_search_blocks", "G05_index_store_and_remove", "G07_nested_hits", "G09_above_threshold",
    "G10_best_of_request", "H18_link_scores_of_vectors",
]
VECTORS = 143


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("searches"))
    rows = [(k, [float((k * p) % 11 - 5) for p in (3, 5, 7, 9)] + [0.5], k % 6) for k in range(1, VECTORS + 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(k,) for k in range(3, 9)], "doc_id long").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(k, f"u{k}") for k in range(7)], "page_id long, url string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", SEARCHES)
def test_every_vector_asks(spark, folder, name):
    con = duckdb.connect()
    for table in ("embeddings", "labels", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    names, rows = mine = rows_of_spark(QUERIES[name](spark, folder))
    assert difference(mine, rows_of_sql(con, SQL[name])) is None
    asked = {"G10_best_of_request": "request_id", "H18_link_scores_of_vectors": "request_id"}.get(name, "query_pos")
    least = 6 if name == "G10_best_of_request" else VECTORS
    assert len({row[names.index(asked)] for row in rows}) == least


def test_every_vector_asks_the_approximate_search(spark, folder):
    assert QUERIES["G04_ivf_search"](spark, folder).select("query_pos").distinct().count() == VECTORS
