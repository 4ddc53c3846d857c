"""Best matches between two sets of vectors, block by block inside Spark tasks.

Pairs are never rows.  A task multiplies a block of vectors with a block of queries
and keeps only the best few of each query, so what leaves it is at most
``k`` rows per query.  These helpers hold the arithmetic of one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from docloom.functions.vectors import SCORE_DIGITS

#: Scores held at once while a block is multiplied (8 bytes each).
MAX_SCORES = 1_000_000
#: Numbers of vectors that are taken from a batch at once.
MAX_NUMBERS = 1_000_000
#: More than rounding can add to a score.
SLACK = 10.0**-SCORE_DIGITS


def matrix(column: pa.Array | pa.ChunkedArray, metric: str) -> np.ndarray:
    """Rows of a list column as a matrix, scaled to length one for cosine; a zero row stays zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    if metric == "cosine" and rows.size:
        norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        rows = np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)
    return rows


class Best:
    """The best ``k`` ids of each query seen so far, ties decided by id.

    A query's best stand in one row each of ``ids`` and ``scores``, in order; what is not filled yet has
    an infinitely low score.  A block of scores is compared with the last of them, so that after the
    first blocks few candidates are left, and only the queries that have any are touched.
    """

    def __init__(self, k: int, min_score: float | None):
        self.k, self.min_score = k, min_score
        self.ids = np.empty((0, k), dtype=object)
        self.scores = np.empty((0, k))

    def _make_room(self, queries: int) -> None:
        if queries > len(self.scores):
            more = max(queries, 2 * len(self.scores)) - len(self.scores)
            self.ids = np.concatenate([self.ids, np.full((more, self.k), None, dtype=object)])
            self.scores = np.concatenate([self.scores, np.full((more, self.k), -np.inf)])

    def add(self, scores: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> None:
        """Take in a block of scores, one row per query number and one column per id, the ids in order."""
        if self.k < 1 or not scores.size:
            return
        self._make_room(int(queries.max()) + 1)
        # a score may still be rounded up to the bound
        bound = self.scores[queries, -1] - SLACK
        if self.min_score is not None:
            bound = np.maximum(bound, self.min_score - SLACK)
        near = scores >= bound[:, None]
        if scores.shape[1] > self.k and np.count_nonzero(near) > 4 * self.k * len(queries):
            # a first block, or many equal scores: no more than the best of each query go on
            scores = np.nan_to_num(np.round(scores, SCORE_DIGITS), copy=False, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k, None]
            level = scores == kth
            near &= (scores > kth) | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= self.k))
        row, column = np.nonzero(near)
        score = np.round(scores[row, column], SCORE_DIGITS)
        if self.min_score is not None:
            above = score > self.min_score
            row, column, score = row[above], column[above], score[above]
        if not len(row):
            return
        # the best of the block for each query: columns are in the order of the ids
        row, column, score = _first(row, (column, -score, row), self.k, row, column, score)
        own, at = np.unique(row, return_inverse=True)
        held = np.repeat(np.arange(len(own)), self.k)
        old_ids, old_scores = self.ids[queries[own]].ravel(), self.scores[queries[own]].ravel()
        there = old_scores > -np.inf
        at = np.concatenate([held[there], at])
        name = np.concatenate([old_ids[there], ids[column]])
        score = np.concatenate([old_scores[there], score])
        id_rank = np.unique(name, return_inverse=True)[1]
        at, name, score = _first(at, (id_rank, -score, at), self.k, at, name, score)
        place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
        new_ids = np.full((len(own), self.k), None, dtype=object)
        new_scores = np.full((len(own), self.k), -np.inf)
        new_ids[at, place], new_scores[at, place] = name, score
        self.ids[queries[own]], self.scores[queries[own]] = new_ids, new_scores

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and scores."""
        query, place = np.nonzero(self.scores > -np.inf)
        return query, self.ids[query, place], self.scores[query, place]


def _first(group: np.ndarray, keys: tuple[np.ndarray, ...], k: int, *columns: np.ndarray) -> list[np.ndarray]:
    """The first ``k`` entries of each group in the order of the keys, of which the last is the group."""
    order = np.lexsort(keys)
    group = group[order]
    kept = order[np.arange(len(group)) - np.searchsorted(group, group, side="left") < k]
    return [column[kept] for column in columns]


def scan(
    best: Best, queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, numbers: np.ndarray | None = None
) -> None:
    """Score vectors against queries in pieces of bounded size.

    ``numbers`` picks some of the queries; without it all of them are meant.
    """
    numbers = np.arange(len(queries)) if numbers is None else numbers
    if not len(vectors) or not len(numbers):
        return
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    step = max(1, MAX_SCORES // len(vectors))
    for start in range(0, len(numbers), step):
        some = numbers[start : start + step]
        best.add(queries[some] @ vectors.T, some, ids)


def pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``most`` rows whose vectors have ``MAX_NUMBERS`` numbers or less (a row at least)."""
    if batch.num_rows:
        numbers = len(batch.column("embedding").flatten()) // batch.num_rows
        step = max(1, min(most, MAX_NUMBERS // max(1, numbers)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
