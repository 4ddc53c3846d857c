"""docloom: document ingestion, indexing and question answering as Spark jobs."""

__version__ = "0.1.0"
