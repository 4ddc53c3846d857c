"""Nearest-neighbour search for whole tables of query vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.fixed_values import (
    LEAF_PROBE_FRACTION,
    MAX_NEIGHBORS,
    MIN_SCORE,
    SEED_VECTOR_ID,
)
from docloom.functions.vectors import unit
from docloom.operators import index
from docloom.operators.blocks import Best, matrix, pieces, scan
from docloom.session import materialise

METRICS = ("cosine", "dot")
#: Largest query matrix that is handed to every task; a greater one is handed over in slices.
BROADCAST_BYTES = 64 * 1024 * 1024
#: Vectors that are compared at once, and queries of a slice where nothing may be shared at once.
VECTOR_BLOCK = 8192
QUERY_BLOCK = 2048

HITS = "query_pos long, id string, score double"
HITS_ARROW = pa.schema([("query_pos", pa.int64()), ("id", pa.string()), ("score", pa.float64())])


def query_batch(vectors: DataFrame, position: Column, max_nn: Column | int, query_id: Column | None = None) -> DataFrame:
    """Queries as a table: position, id, vector and how many neighbours each wants.

    A query without an id is called ``query`` + position.
    """
    named = F.concat(F.lit("query"), position.cast("string"))
    wanted = max_nn if isinstance(max_nn, Column) else F.lit(max_nn)
    return vectors.select(
        position.cast("long").alias("query_pos"),
        F.coalesce(query_id, named).alias("query_id") if query_id is not None else named.alias("query_id"),
        "embedding",
        wanted.cast("int").alias("max_nn"),
    )


def normalise(vectors: DataFrame) -> DataFrame:
    """Unit vectors, so that the dot product is the cosine."""
    return vectors.withColumn("embedding", unit(F.col("embedding")))


def without_seed(vectors: DataFrame) -> DataFrame:
    """The row an index is created with is not content."""
    return vectors.filter(F.col("id") != SEED_VECTOR_ID)


# --- scoring -------------------------------------------------------------------


def hits_of(best: Best, positions: np.ndarray) -> pa.RecordBatch:
    query, ids, scores = best.rows()
    return pa.RecordBatch.from_arrays(
        [pa.array(positions[query]), pa.array(ids, pa.string()), pa.array(scores)], schema=HITS_ARROW
    )


def few_tasks(vectors: DataFrame) -> DataFrame:
    """A few tasks per core: each emits its best rows once, however many splits it reads."""
    return vectors.coalesce(4 * vectors.sparkSession.sparkContext.defaultParallelism)


def query_matrix(queries: DataFrame, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and vectors of a query batch whose size was checked."""
    table = queries.select("query_pos", "embedding").toArrow()
    return table["query_pos"].to_numpy(), matrix(table["embedding"], metric)


def _scan_all(queries: DataFrame, vectors: DataFrame, k: int, metric: str, min_score: float | None) -> tuple[Broadcast, DataFrame]:
    """Hand a small query matrix to every task and read the vectors once, without a shuffle."""
    shared, most = queries.sparkSession.sparkContext.broadcast(query_matrix(queries, metric)), VECTOR_BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions, wanted = shared.value
        best = Best(k, min_score)
        for batch in batches:
            for piece in pieces(batch, most):
                ids = np.asarray(piece.column("id").to_pylist(), dtype=object)
                scan(best, wanted, matrix(piece.column("embedding"), metric), ids)
        yield hits_of(best, positions)

    return shared, few_tasks(vectors.select("id", "embedding")).mapInArrow(run, HITS)


def each_slice(scan_slice: Callable[[int], tuple[Broadcast, DataFrame]], k: int, slices: int) -> DataFrame:
    """The hits of one slice of the queries after the other.

    Every slice reads the vectors once where they lie; no vector is ever shuffled.  What a slice leaves
    is the best few hits of its queries, written to the shared folder, and what it shared is given up
    before the next is made.
    """
    order, found = W.partitionBy("query_pos").orderBy(F.desc("score"), "id"), None
    for number in range(slices):
        shared, hits = scan_slice(number)
        placed = hits.withColumn("place", F.row_number().over(order))
        best = materialise(placed.where(F.col("place") <= k).drop("place"), "slice-hits")
        shared.unpersist()
        found = best if found is None else found.unionByName(best)
    return found


def _block_counts(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def _rank(hits: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """Best hits of each query over all blocks; the literal bound lets Spark cut before the shuffle."""
    order = W.partitionBy("query_pos").orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    distance = 1 - F.col("score") if metric == "cosine" else F.col("score")
    return (
        ranked.join(queries.select("query_pos", "query_id", "max_nn"), "query_pos")
        .filter(F.col("rank") <= F.col("max_nn"))
        .select("query_pos", "query_id", "id", "score", distance.alias("distance"), "rank")
    )


def _greatest_k(queries: DataFrame) -> tuple[int, int, int]:
    """Rows, dimensions and greatest wanted neighbour count of a query batch."""
    row = queries.agg(
        F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"), F.max("max_nn").alias("k")
    ).first()
    return row.n, row.d or 0, row.k or 0


def exact(
    queries: DataFrame,
    vectors: DataFrame,
    metric: str = "cosine",
    min_score: float | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The ``max_nn`` nearest vectors of every query, compared with every vector.

    ``min_score`` drops hits at or below it inside the tasks already.  Queries of more than
    ``broadcast_bytes`` are taken slice by slice.  The work is the number of queries times the number
    of vectors; see ``ivf`` for large tables.
    """
    _check_metric(metric)
    rows, dimensions, k = _greatest_k(queries)
    if rows * dimensions * 8 <= broadcast_bytes:
        hits = _scan_all(queries, vectors, k, metric, min_score)[1]
    else:
        slices = _block_counts(rows, broadcast_bytes // (dimensions * 8) or QUERY_BLOCK)

        def scan_slice(number: int) -> tuple[Broadcast, DataFrame]:
            own = queries.where(F.pmod(F.xxhash64("query_pos"), F.lit(slices)) == number)
            return _scan_all(own, vectors, k, metric, min_score)

        hits = each_slice(scan_slice, k, slices)
    return _rank(hits, queries, k, metric)


def _check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is not supported, use one of {METRICS}")


# --- hits ----------------------------------------------------------------------


def above(hits: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    return hits.filter(F.col("score") > min_score)


def best_of_request(hits: DataFrame, count: int = MAX_NEIGHBORS) -> DataFrame:
    """The best hits over all query vectors of one request."""
    order = W.partitionBy("request_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= count)


def nested(hits: DataFrame) -> DataFrame:
    """One row per query with its neighbours as an array; a query has a few hits at most."""
    return hits.groupBy("query_pos", "query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("neighbors")
    )


# --- one interface over both searches ------------------------------------------


@dataclass
class VectorIndex:
    """A vector table with a way to search it.

    ``mode`` is ``exact`` or ``ivf``; the latter needs ``leaves`` (see ``operators.ivf``)
    and a ``leaf`` column on the vectors.
    """

    vectors: DataFrame
    metric: str = "cosine"
    mode: str = "exact"
    leaves: DataFrame | None = None
    probe_fraction: float = LEAF_PROBE_FRACTION

    def __post_init__(self) -> None:
        _check_metric(self.metric)
        if self.mode not in ("exact", "ivf"):
            raise ValueError(f"search mode {self.mode!r} is not supported, use exact or ivf")
        if self.mode == "ivf" and self.leaves is None:
            raise ValueError("search mode ivf needs the leaves of the index")

    def find(self, queries: DataFrame, min_score: float | None = None) -> DataFrame:
        vectors = without_seed(self.vectors)
        if self.mode == "exact":
            return exact(queries, vectors, self.metric, min_score)
        from docloom.operators import ivf

        return ivf.search(
            queries, vectors, self.leaves, self.metric, min_score, self.probe_fraction
        )

    def store(self, rows: DataFrame) -> VectorIndex:
        """The index with new or replaced vectors."""
        new = rows
        if self.mode == "ivf":
            from docloom.operators import ivf

            kept = self.vectors.join(new.select("id"), "id", "left_anti")
            return self._with(kept.unionByName(ivf.assign(index.latest_vectors(new), self.leaves)))
        return self._with(index.upsert_vectors(self.vectors.select("id", "embedding"), new))

    def remove(self, ids: DataFrame) -> VectorIndex:
        return self._with(index.delete_ids(self.vectors, ids))

    def _with(self, vectors: DataFrame) -> VectorIndex:
        return VectorIndex(
            vectors, self.metric, self.mode, self.leaves, self.probe_fraction
        )
