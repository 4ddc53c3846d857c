import duckdb
import pytest

import __spark_entry__ as entry
from docloom.catalog import QUERIES, SQL
from tests.compare import connect, difference, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql_but_for_those_it_cannot_express():
    assert set(QUERIES) - set(SQL) == {"G04_ivf_search"}


SAMPLE = [
    "A06_content_by_key", "B06_rewrite_buckets", "C02_route_requests", "C14_expand_folders", "C16_extract_by_type",
    "E03_classify_failures", "F04_apply_to_cells", "G02_exact_search", "H05_last_exchanges", "H21_answer_questions",
    "I05_delete_documents", "M03_chunk_texts", "S01_minute_windows", "S05_session_state",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    """A cross-section; ``python -m tests.compare`` runs all of them."""
    assert difference(rows_of_spark(entry.queries()[name](spark, SF)), rows_of_sql(con, entry.oracle_sql()[name])) is None


def test_pages_of_one_url_are_chunked_once_each(spark, tmp_path):
    """Of equal lengths, since the SQL cuts pages of one url at the length of either of them."""
    pages = [(k, f"u{k // 2}", f"<p>Page {k} has few words.</p>") for k in range(40)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name, rows in (("M04_page_chunks", 40), ("M04_unread_links", 4)):
        mine = rows_of_spark(QUERIES[name](spark, str(tmp_path)))
        assert len(mine[1]) == rows
        assert difference(mine, rows_of_sql(con, SQL[name])) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 40
