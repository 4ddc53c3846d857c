"""Registered queries over the given tables."""

from docloom.catalog import answer_queries, index_queries, ingest_queries, store_queries  # noqa: F401
from docloom.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
