"""The operators that SQL can express give the rows of their SQL; the rest are listed."""

import pytest

from docloom.llm import queries
from tests.compare import connect, difference, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.SQL)
def test_rows_equal_the_sql(spark, name):
    found = rows_of_spark(queries.QUERIES[name](spark, SF))
    assert difference(found, rows_of_sql(connect(SF), queries.SQL[name])) is None


def test_the_rest_has_no_sql_form():
    """Merges of tokens, families of rules, edit distances, learned scores and checksums."""
    assert set(queries.QUERIES) - set(queries.SQL) == {
        "op1_bpe", "op2_licenses", "op3_line_dedup", "op4_quality", "op6_token_counts", "op11_lm_scores", "op13_spelling",
    }
