"""Scores of texts under a word n-gram model smoothed by deleted interpolation.

A word's probability mixes the maximum-likelihood estimates of all orders with a uniform one.  The
mixture depends on how often the word's context was seen (powers of two); its weights are learned by
expectation-maximisation on one part of the training documents, with that part's own counts deleted.

1. ``_slices``: every task packs its texts into slices of about ``SLICE_TOKENS`` tokens: the distinct
   words as hashes, and the tokens as numbers of them.  Slices are written once.
2. ``_questions``: a slice adds up its n-grams before anything is shuffled and sends each distinct one
   to a bucket by its hash, so a frequent n-gram is one entry a slice.  ``_answer`` adds up a bucket
   and sends every slice the corpus counts of its own n-grams.  No table of n-grams is ever broadcast.
3. ``_cells``: the slices of the deleted part give a histogram of (context bucket, relative size of
   the estimates), added up in Spark; its size is bounded by its grid, whatever the corpus.
4. ``_scores``: the slices meet their answers and every text is scored.

Words and n-grams are told apart by 64-bit hashes of their contents.  The uniform estimate has one
class for all unknown words, so probabilities add up to one.

Defined cases: a null text is empty and scores its end only; a row without ``doc_id`` is a training
document (its crc32 counts as 0); repeated rows are counted and scored each; columns besides ``doc_id``
and ``text`` are not looked at; without training documents all words are unknown and have probability 1
of the one class.  A text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import words
from docloom.llm.packing import pack, pack_sorted, unpack, unpack_sorted
from docloom.session import materialise

Batches = Iterator[pa.RecordBatch]

SLICE_TOKENS = 1 << 21
#: Distinct n-grams that a bucket is expected to hold at most.
BUCKET_ENTRIES = 1 << 20
#: One training document in this many is deleted to learn the weights.
PARTS = 8
#: Grid of the histogram: estimates relative to the largest, in halves of a power of two.
STEPS_A_DOUBLING = 2
FLOOR_DOUBLINGS = 16
ZERO = STEPS_A_DOUBLING * FLOOR_DOUBLINGS + 1
#: Context buckets of one order: no such context, then powers of two of its count.
CONTEXT_BUCKETS = 64
ROUNDS = 200

_START_HASH = np.uint64(0x2545F4914F6CDD1D)
_END_HASH = np.uint64(0x9FB21C651E98DF25)
_LEVEL = np.uint64(0xD1342543DE82EF95)

SLICE = "slice long, kind int, doc_id array<long>, counts array<long>, vocabulary binary, tokens binary"
ANSWER = "slice long, bucket int, counts binary, n_known long, n_known_rest long"
SCORE = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)
HELD_OUT, TRAINING, DELETED = 0, 1, 2


# --- slices --------------------------------------------------------------------


class _Open:
    """Texts of one kind that a task has gathered for its next slice."""

    def __init__(self, kind: int):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.ids: list[int | None] = []
        self.counts: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: list[int | None], counts: np.ndarray, hashes: np.ndarray) -> None:
        self.ids += ids
        self.counts.append(counts)
        self.hashes.append(hashes)
        self.size += len(hashes) + len(ids)

    def close(self, number: int) -> pa.RecordBatch:
        hashes = np.concatenate(self.hashes)
        vocabulary, at, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        by_count = np.argsort(-counts, kind="stable")
        number_of = np.empty(len(by_count), dtype=np.int64)
        number_of[by_count] = np.arange(len(by_count))
        row = pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([self.kind], pa.int32()),
                pa.array([self.ids], pa.list_(pa.int64())),
                pa.array([np.concatenate(self.counts)], pa.list_(pa.int64())),
                pa.array([vocabulary[by_count].tobytes()], pa.binary()),
                pa.array([pack(number_of[at])], pa.binary()),
            ],
            names=["slice", "kind", "doc_id", "counts", "vocabulary", "tokens"],
        )
        self.clear()
        return row


def _slices(batches: Batches) -> Batches:
    task, number = TaskContext.get().partitionId() << 32, 0
    kinds = [_Open(kind) for kind in (HELD_OUT, TRAINING, DELETED)]
    for batch in batches:
        for rows, found in words.chunks(batch, "text", lower=True):
            kind_of = rows.column("kind").to_numpy()
            ids, counts = rows.column("doc_id"), found.counts()
            word_kind = kind_of[found.text_of]
            for own in kinds:
                picked = np.flatnonzero(kind_of == own.kind)
                if len(picked):
                    own.add(ids.take(pa.array(picked)).to_pylist(), counts[picked], found.hashes[word_kind == own.kind])
                if own.size >= SLICE_TOKENS:
                    yield own.close(task + number)
                    number += 1
    for own in kinds:
        if own.ids:
            yield own.close(task + number)
            number += 1


@dataclass
class _Level:
    """The n-grams of one order in a slice: hashes of the distinct ones, in order, and who has which."""

    keys: np.ndarray
    of_position: np.ndarray  # number of the n-gram ending at a position, -1 where none is wanted
    counted: np.ndarray  # how often each stands at a position that counts


class _Slice:
    """A slice's tokens with a start before and an end behind each text, and its n-grams."""

    def __init__(self, vocabulary: bytes, tokens: bytes, counts: np.ndarray, order: int):
        known = np.frombuffer(vocabulary, dtype=np.uint64)
        start, end = len(known), len(known) + 1
        known = np.append(known, [_START_HASH, _END_HASH])
        pads = max(order - 1, 1)
        lengths = counts + pads + 1
        first = np.cumsum(lengths) - lengths
        self.stream = np.full(int(lengths.sum()), start, dtype=np.int64)
        self.text_of = np.repeat(np.arange(len(counts)), lengths)
        place = np.arange(len(self.stream)) - first[self.text_of]
        word = (place >= pads) & (place < lengths[self.text_of] - 1)
        self.stream[word] = unpack(tokens).astype(np.int64)
        self.stream[first + lengths - 1] = end
        self.predicted = place >= pads
        self.last_start = place == pads - 1
        self.levels: list[_Level] = []
        hash_of = words.mix(known ^ _LEVEL)
        previous, previous_keys = self.stream, hash_of
        for level in range(1, order + 1):
            wanted = self.predicted | self.last_start if level < order or order == 1 else self.predicted
            at = np.flatnonzero(wanted)
            if level == 1:
                pairs = self.stream[at]
            else:
                pairs = previous[at - 1] * np.int64(len(known)) + self.stream[at]
            distinct, which = np.unique(pairs, return_inverse=True)
            if level == 1:
                keys = hash_of[distinct]
            else:
                head, tail = distinct // len(known), distinct % len(known)
                keys = words.mix(previous_keys[head] * _LEVEL + hash_of[tail])
            order_of = np.argsort(keys)
            rank = np.empty(len(order_of), dtype=np.int64)
            rank[order_of] = np.arange(len(order_of))
            keys = keys[order_of]
            of_position = np.full(len(self.stream), -1, dtype=np.int64)
            of_position[at] = rank[which]
            self.levels.append(_Level(keys, of_position, np.bincount(rank[which], minlength=len(keys)).astype(np.uint64)))
            if level > 1:
                previous, previous_keys = of_position, keys


def _open_slice(row: dict, order: int) -> _Slice:
    return _Slice(row["vocabulary"], row["tokens"], np.array(row["counts"], dtype=np.int64), order)


# --- counts --------------------------------------------------------------------


@dataclass(frozen=True)
class _Buckets:
    """Buckets of each order: those of order k have the numbers from ``first[k - 1]`` on."""

    sizes: tuple[int, ...]

    @classmethod
    def over(cls, tokens: int, order: int) -> _Buckets:
        wanted = max(1, -(-tokens // BUCKET_ENTRIES))
        return cls(tuple(max(1, -(-wanted // 4)) if level == 1 else wanted for level in range(1, order + 1)))

    def limits(self, level: int, keys: np.ndarray) -> tuple[int, np.ndarray]:
        """Number of the order's first bucket, and where each begins among sorted keys."""
        size = self.sizes[level - 1]
        of_key = ((keys >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        return sum(self.sizes[: level - 1]), np.searchsorted(of_key, np.arange(size + 1, dtype=np.uint64))


def _questions(order: int, buckets: _Buckets) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                found = _open_slice(row, order)
                for level, own in enumerate(found.levels, start=1):
                    first, limits = buckets.limits(level, own.keys)
                    counted = own.counted if row["kind"] != HELD_OUT else np.zeros_like(own.counted)
                    parts = [(k, a, b) for k, (a, b) in enumerate(zip(limits[:-1], limits[1:], strict=True)) if a < b]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([first + k for k, _, _ in parts], pa.int32()),
                            pa.array([row["slice"]] * len(parts), pa.int64()),
                            pa.array([row["kind"]] * len(parts), pa.int32()),
                            pa.array([pack_sorted(own.keys[a:b]) for _, a, b in parts], pa.binary()),
                            pa.array([pack(counted[a:b]) for _, a, b in parts], pa.binary()),
                        ],
                        names=["bucket", "slice", "kind", "keys", "counts"],
                    )

    return run


def _answer(first_of_second: int) -> Callable[[pa.Table], pa.Table]:
    """Corpus counts, and those of the deleted part, for each slice's n-grams of one bucket.

    Of the first order the number of known words, with and without the deleted part, comes along.
    """

    start = words.mix(np.array([_START_HASH ^ _LEVEL], dtype=np.uint64))

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys = [unpack_sorted(x.as_py()) for x in table.column("keys")]
        counts = [unpack(x.as_py()) for x in table.column("counts")]
        kinds = table.column("kind").to_numpy()
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        deleted = np.repeat(kinds == DELETED, [len(k) for k in keys])
        every = np.concatenate(counts)
        whole, part = np.zeros(len(distinct), dtype=np.uint64), np.zeros(len(distinct), dtype=np.uint64)
        np.add.at(whole, which, every)
        np.add.at(part, which[deleted], every[deleted])
        known = known_rest = 0
        if bucket < first_of_second:
            word = distinct != start[0]
            known, known_rest = int((whole[word] > 0).sum()), int((whole[word] > part[word]).sum())
        limits = np.cumsum([0, *(len(k) for k in keys)])
        replies = []
        for a, b in zip(limits[:-1], limits[1:], strict=True):
            own = which[a:b]
            replies.append(pack(np.concatenate([whole[own], part[own]])))
        rest = len(replies) - 1
        return pa.table(
            {
                "slice": table.column("slice"),
                "bucket": pa.array([bucket] * len(replies), pa.int32()),
                "counts": pa.array(replies, pa.binary()),
                "n_known": pa.array([known, *[0] * rest], pa.int64()),
                "n_known_rest": pa.array([known_rest, *[0] * rest], pa.int64()),
            }
        )

    return run


@dataclass(frozen=True)
class _Totals:
    tokens: int
    known: int
    deleted_tokens: int
    known_rest: int


def _counts(found: _Slice, answers: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, corpus and deleted counts of the slice's n-grams."""
    by_bucket = np.argsort(answers.column("bucket").to_numpy(), kind="stable")
    replies = [unpack(answers.column("counts")[int(k)].as_py()).reshape(2, -1) for k in by_bucket]
    both = np.concatenate(replies, axis=1)
    limits = np.cumsum([len(level.keys) for level in found.levels])[:-1]
    return [(own[0], own[1]) for own in np.split(both, limits, axis=1)]


def _estimates(found: _Slice, counts: list[np.ndarray], tokens: int, known: int) -> tuple[np.ndarray, np.ndarray]:
    """For each predicted token the context bucket, and its estimates from the uniform one up.

    The bucket is (order of the longest context seen) * CONTEXT_BUCKETS + power of two of its count.
    """
    at = np.flatnonzero(found.predicted)
    p = np.zeros((len(counts) + 1, len(at)))
    p[0] = 1 / (known + 1)
    bucket = np.zeros(len(at), dtype=np.int64)
    for level, own in enumerate(counts, start=1):
        seen = own[found.levels[level - 1].of_position[at]].astype(np.float64)
        if level == 1:
            p[1] = seen / tokens if tokens else p[0]
            continue
        context = counts[level - 2][found.levels[level - 2].of_position[at - 1]].astype(np.float64)
        has = context > 0
        p[level][has] = seen[has] / context[has]
        bucket[has] = (level - 1) * CONTEXT_BUCKETS + np.floor(np.log2(context[has])).astype(np.int64)
    return bucket, p


def relative_sizes(p: np.ndarray) -> np.ndarray:
    """Each token's estimates relative to its largest, on the histogram's grid."""
    with np.errstate(divide="ignore"):
        down = -np.log2(p / p.max(axis=0)) * STEPS_A_DOUBLING
    return np.where(p > 0, np.minimum(np.rint(down), ZERO - 1), ZERO).astype(np.int64)


def _cells(order: int, totals: _Totals) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(slices: pa.Table, answers: pa.Table) -> pa.Table:
        cells = []
        for row in slices.to_pylist():
            found = _open_slice(row, order)
            rest = [whole - part for whole, part in _counts(found, answers)]
            bucket, p = _estimates(found, rest, totals.tokens - totals.deleted_tokens, totals.known_rest)
            cell = bucket
            for sizes in relative_sizes(p):
                cell = cell * (ZERO + 1) + sizes
            cells.append(cell)
        cell, n = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *cells]), return_counts=True)
        return pa.table({"cell": pa.array(cell), "n": pa.array(n.astype(np.int64))})

    return run


# --- weights -------------------------------------------------------------------


def learn_weights(cells: np.ndarray, n: np.ndarray, order: int) -> np.ndarray:
    """Weights of the estimates (uniform first) for every context bucket, by expectation-maximisation.

    Every estimate that a bucket can use starts with one observation of its own, so no weight becomes
    zero.  A bucket that no held-out token fell into takes the weights of the nearest bucket below it
    of its order, or else weighs its estimates alike.
    """
    sizes, left = [], cells
    for _ in range(order + 1):
        sizes.append(left % (ZERO + 1))
        left = left // (ZERO + 1)
    codes = np.stack(sizes[::-1])
    p = np.where(codes == ZERO, 0.0, 2.0 ** (-codes / STEPS_A_DOUBLING))
    weights = np.zeros((order * CONTEXT_BUCKETS, order + 1))
    for bucket in range(len(weights)):
        usable = bucket // CONTEXT_BUCKETS + 2
        own = left == bucket
        if not own.any():
            below = bucket % CONTEXT_BUCKETS > 0 and weights[bucket - 1].any()
            weights[bucket] = weights[bucket - 1] if below else np.r_[np.full(usable, 1 / usable), np.zeros(order + 1 - usable)]
            continue
        w, seen = np.full(usable, 1 / usable), p[:usable, own]
        for _ in range(ROUNDS):
            share = w[:, None] * seen
            new = (share / share.sum(axis=0) * n[own]).sum(axis=1) + 1
            new /= new.sum()
            moved, w = np.abs(new - w).max(), new
            if moved < 1e-9:
                break
        weights[bucket, :usable] = w
    return weights


# --- scores --------------------------------------------------------------------


def _scores(order: int, totals: _Totals, weights: np.ndarray) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(slices: pa.Table, answers: pa.Table) -> pa.Table:
        tables = []
        for row in slices.to_pylist():
            found = _open_slice(row, order)
            whole = [counts for counts, _ in _counts(found, answers)]
            bucket, p = _estimates(found, whole, totals.tokens, totals.known)
            at = np.flatnonzero(found.predicted)
            own = whole[0][found.levels[0].of_position[at]].astype(np.float64)
            text_of, texts = found.text_of[at], len(row["doc_id"])
            score = np.log10((weights[bucket].T * p).sum(axis=0))
            base = np.log10((own + 1) / (totals.tokens + totals.known + 1))
            tables.append(
                pa.table(
                    {
                        "doc_id": pa.array(row["doc_id"], pa.int64()),
                        "held_out": pa.array([row["kind"] == HELD_OUT] * texts),
                        "n_tokens": pa.array(np.bincount(text_of, minlength=texts)),
                        "n_known": pa.array(np.bincount(text_of[own > 0], minlength=texts)),
                        "train_tokens": pa.array([totals.tokens] * texts, pa.int64()),
                        "base_score": pa.array(np.bincount(text_of, base, minlength=texts)),
                        "score": pa.array(np.bincount(text_of, score, minlength=texts)),
                    }
                )
            )
        return pa.concat_tables(tables) if tables else pa.table({})

    return run


def held_out() -> Column:
    """Documents that are scored only: the crc32 of their id leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 7 == 2


@dataclass
class Model:
    """Slices with the corpus counts of their n-grams, and what was learned from them."""

    order: int
    slices: DataFrame
    answers: DataFrame
    totals: _Totals
    weights: np.ndarray

    def scores(self) -> DataFrame:
        """Per document the token counts, the add-one unigram score and the model's score."""
        return self._with_answers(self.slices).applyInArrow(_scores(self.order, self.totals, self.weights), SCORE)

    def _with_answers(self, slices: DataFrame):
        return slices.groupBy("slice").cogroup(self.answers.groupBy("slice"))


def fit(documents: DataFrame, scored_only: Column | None = None, order: int = 2) -> Model:
    """A model of the given order (1 to 3), learned from the documents that are not ``scored_only``."""
    if order not in (1, 2, 3):
        raise ValueError("the order is 1, 2 or 3")
    id_ = F.col("doc_id").cast("long").alias("doc_id")
    deleted = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(PARTS)) == 0
    kind = F.when(held_out() if scored_only is None else scored_only, HELD_OUT).when(deleted, DELETED).otherwise(TRAINING)
    texts = documents.select(id_, "text", kind.cast("int").alias("kind"))
    slices = materialise(texts.mapInArrow(_slices, SLICE), "lm-slices")
    sizes = slices.select("kind", F.expr("aggregate(counts, 0L, (n, x) -> n + x + 1)").alias("n"))
    tokens = {row.kind: row.n for row in sizes.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    buckets = _Buckets.over(sum(tokens.values()), order)
    questions = slices.mapInArrow(
        _questions(order, buckets), "bucket int, slice long, kind int, keys binary, counts binary"
    )
    answers = materialise(questions.groupBy("bucket").applyInArrow(_answer(buckets.sizes[0]), ANSWER), "lm-answers")
    known = answers.agg(F.sum("n_known"), F.sum("n_known_rest")).first()
    deleted_tokens = tokens.get(DELETED, 0)
    totals = _Totals(tokens.get(TRAINING, 0) + deleted_tokens, known[0] or 0, deleted_tokens, known[1] or 0)
    model = Model(order, slices, answers.drop("n_known", "n_known_rest"), totals, np.empty(0))
    part = slices.where(F.col("kind") == DELETED)
    wanted = model.answers.join(part.select("slice"), "slice", "left_semi")
    cells = (
        part.groupBy("slice")
        .cogroup(wanted.groupBy("slice"))
        .applyInArrow(_cells(order, totals), "cell long, n long")
        .groupBy("cell")
        .agg(F.sum("n").alias("n"))
        .toArrow()
        .sort_by("cell")
    )
    model.weights = learn_weights(cells.column("cell").to_numpy(), cells.column("n").to_numpy(), order)
    return model


def score_documents(documents: DataFrame, order: int = 2) -> DataFrame:
    """Scores of all documents under a model of those that :func:`held_out` does not name."""
    return fit(documents, order=order).scores()
