"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

The near pairs of a vocabulary A are what the composition A o T o A accepts, where T is the one-edit
transducer: it copies symbols, makes one edit, and copies again.  The work is cut by initial state:

1. The first place where two near words differ lies in the first or in the second half of the shorter
   one (of length M).  If in the second, the acceptor takes both to one state by the first half; if in
   the first, the reversed acceptor does by the second half.  Each such state is a partition with an
   acceptor for the rests of its words of length M and one for those of length M + 1.  A partition of
   more than ``PARTITION_WORDS`` words is cut anew by halves of the rests, down to rests of one symbol.
2. A task takes whole partitions, builds their minimised acceptor from the leaves up, with the number
   of words before every arc, and composes all of them at once: pairs of states are followed symbol by
   symbol, before the edit and after it.  The word numbers add up along the arcs.
3. The edit is made at the first place where the words differ, and each place belongs to one partition,
   so every pair comes once.  Pairs are added up by word in the task; they are never rows.

Defined cases: a null text has no words; a row without ``doc_id`` counts with an empty id; repeated
rows count again; columns besides ``doc_id`` and ``text`` are not looked at; of equally frequent near
words the first in code-point order is the form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import materialise

Batches = Iterator[pa.RecordBatch]

#: Letters A to Z, a to z and U+00C0 to U+00FF.
RUN = "[A-Za-zÀ-ÿ]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: One run of a document in so many loses a symbol, told by its checksum.
DAMAGED_EVERY = 97
#: A form is at least so many times as frequent as its variant.
FORM_TIMES = 2

PARTITION_WORDS = 1 << 14
#: Symbols that a task composes at once.
BATCH_SYMBOLS = 1 << 18

NEAR = "word string, n_near long, form_n long, form string"


# --- words ---------------------------------------------------------------------


def vocabulary(documents: DataFrame) -> DataFrame:
    """(word, n): damaged lower-cased runs of at least five code points that occur at least three times."""
    runs = F.regexp_extract_all("text", F.lit(RUN), F.lit(0))
    long_runs = F.filter(runs, lambda run: F.length(run) >= LEAST_LENGTH)
    own = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(long_runs).alias("run"))
    lowered = own.select(
        "id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", CAPITALS, CAPITALS.lower())).otherwise(F.col("run")).alias("run")
    )
    checked = lowered.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    words = checked.select(F.when(F.col("h") % DAMAGED_EVERY == 0, damaged).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


# --- partitions ----------------------------------------------------------------

# A row of a partition: its key, whether the word is the longer one of its pairs, the rest of the word
# that may differ, and the limits of the place of the edit, counted in the shorter word.
_ROW = ["key", "longer", "rest", "word", "n", "low", "high", "shorter"]


def _halves(rest: Column, low: Column, high: Column, longer: Column, key: Column) -> Column:
    """Both cuts of a rest: by its first half, and by its second."""
    size = high - low
    half = F.floor(size / 2).cast("int")
    tail = size - half
    first = F.struct(
        F.concat(key, F.lit(">"), F.substring(rest, F.lit(1), half)).alias("key"),
        F.substring(rest, half + 1, F.length(rest)).alias("rest"),
        (low + half).alias("low"),
        high.alias("high"),
    )
    second = F.struct(
        F.concat(key, F.lit("<"), F.substring(rest, F.length(rest) - tail + 1, tail)).alias("key"),
        F.substring(rest, F.lit(1), half + longer).alias("rest"),
        low.alias("low"),
        (low + half).alias("high"),
    )
    return F.filter(F.array(first, second), lambda x: x["high"] > x["low"])


def _cut(rows: DataFrame) -> DataFrame:
    cuts = _halves(F.col("rest"), F.col("low"), F.col("high"), F.col("longer"), F.col("key"))
    parts = rows.select("longer", "word", "n", "shorter", F.explode(cuts).alias("cut"))
    return parts.select("longer", "word", "n", "shorter", "cut.*").select(*_ROW)


def partitions(words: DataFrame, most: int = PARTITION_WORDS) -> DataFrame:
    """The rows of all partitions of a table (word, n), none of many more than ``most`` words.

    Rests of one symbol are not cut: there are no more of them than symbols, and pairs of symbols.
    """
    whole = words.where(F.length("word") > 0).select(
        "word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer")
    )
    sized = whole.withColumn("shorter", F.length("word") - F.col("longer")).where("shorter > 0")
    rows = _cut(
        sized.select(
            F.lpad(F.col("shorter").cast("string"), 10, "0").alias("key"),
            "longer", F.col("word").alias("rest"), "word", "n",
            F.lit(0).alias("low"), F.col("shorter").alias("high"), "shorter",
        )
    )
    done = None
    while True:
        large = materialise(
            rows.where("high - low > 1").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > most).select("key"),
            "large-partitions",
        )
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = _cut(rows.join(large, "key", "left_semi"))


# --- the minimised acceptor ----------------------------------------------------


class Acceptor:
    """Minimised acceptor of sorted distinct rests; those with one root have one length.

    State 0 accepts.  Arcs of a state are sorted by symbol; ``before`` counts the words of a root that
    come before those of the arc, so the numbers on a path add up to the number of its word.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, first_of_root: np.ndarray):
        rows = len(lengths)
        shared = np.full(rows, -1, dtype=np.int64)
        if rows > 1:
            same = symbols[1:] == symbols[:-1]
            shared[1:] = np.where(same.all(axis=1), symbols.shape[1], (~same).argmax(axis=1))
        shared[first_of_root] = -1
        self.first = [np.zeros(1, dtype=np.int64)]  # per state its first arc
        self.arcs = [np.zeros(1, dtype=np.int64)]  # per state its number of arcs
        self.symbol: list[np.ndarray] = []
        self.target: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.root = np.zeros(rows, dtype=np.int64)
        states, arcs = 1, 0
        owners = np.arange(rows)  # rows at which the nodes of a height begin
        state_of = np.zeros(rows, dtype=np.int64)
        words_of = np.ones(rows, dtype=np.int64)
        for height in range(1, int(lengths.max(initial=0)) + 1):
            # A node at this height begins where a row leaves the one before it above the node.
            picked = lengths[owners] >= height
            ends = owners[picked]
            symbol = symbols[ends, lengths[ends] - height]
            target, words = state_of[picked], words_of[picked]
            begins = shared[ends] < lengths[ends] - height
            at = np.flatnonzero(begins)
            counts = np.diff(np.append(at, len(ends)))
            total = np.add.reduceat(words, at)
            before = np.cumsum(words) - words
            before -= np.repeat(before[at], counts)
            # Equal lists of (symbol, target) are one state.
            pairs = np.ascontiguousarray(np.stack([symbol.astype(np.int64), target], axis=1))
            names = np.empty(len(at), dtype=np.int64)
            single = counts == 1
            lone, which = np.unique(pairs[at[single]].view([("s", np.int64), ("t", np.int64)]).reshape(-1), return_inverse=True)
            names[single] = which
            known: dict[bytes, int] = {}
            body = pairs.tobytes()
            several = np.flatnonzero(~single)
            for k, a, count in zip(several.tolist(), at[several].tolist(), counts[several].tolist(), strict=True):
                names[k] = known.setdefault(body[16 * a : 16 * (a + count)], len(lone) + len(known))
            _, example = np.unique(names, return_index=True)
            width = counts[example]
            where = np.repeat(at[example] - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
            self.first.append(arcs + np.cumsum(width) - width)
            self.arcs.append(width)
            self.symbol.append(symbol[where].astype(np.int64))
            self.target.append(target[where])
            self.before.append(before[where])
            state_of, words_of, owners = states + names, total, ends[at]
            rooted = lengths[owners] == height
            self.root[owners[rooted]] = state_of[rooted]
            states, arcs = states + len(example), arcs + int(width.sum())
        none = [np.empty(0, dtype=np.int64)]
        self.first, self.arcs = np.concatenate(self.first), np.concatenate(self.arcs)
        self.symbol, self.target, self.before = (np.concatenate(x or none) for x in (self.symbol, self.target, self.before))
        self.arc_key = np.repeat(np.arange(states), self.arcs) * (1 << 21) + self.symbol

    def leave(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All arcs of the given states: which of them each leaves, and the arc."""
        counts = self.arcs[state]
        which = np.repeat(np.arange(len(state)), counts)
        begins = np.cumsum(counts) - counts
        return which, self.first[state][which] + np.arange(len(which)) - begins[which]

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each state has an arc with the symbol, and which."""
        key = state * (1 << 21) + symbol
        arc = np.minimum(np.searchsorted(self.arc_key, key), max(len(self.arc_key) - 1, 0))
        return self.arc_key[arc] == key, arc

    def both(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs with one symbol that leave both states of a pair: the pair, and either arc."""
        which, arc = self.leave(p)
        has, other = self.follow(q[which], self.symbol[arc])
        return which[has], arc[has], other[has]


_NO_SYMBOL = -1


def compose(acceptor: Acceptor, short_roots: np.ndarray, long_roots: np.ndarray, open_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that the acceptor, the one-edit transducer and the acceptor accept together.

    ``short_roots`` and ``long_roots`` are first rows of roots; of a partition without longer (shorter)
    words the entry is -1.  ``open_end`` tells for rows whether their rest ends the word: only then may
    a symbol be inserted behind it.
    """
    none = np.empty(0, dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    own = short_roots[short_roots >= 0]
    p, i = acceptor.root[own], own  # before a replacement: both words of the same length, one state
    mixed = (short_roots >= 0) & (long_roots >= 0)
    a, b = acceptor.root[short_roots[mixed]], acceptor.root[long_roots[mixed]]  # before an insertion
    ia, ib = short_roots[mixed], long_roots[mixed]
    x, y, ix, iy, forbidden = none, none, none, none, none  # after the edit
    while len(p) or len(a) or len(x):
        ends = (x == 0) & (y == 0)
        found.append((ix[ends], iy[ends]))
        which, s, t = acceptor.both(x, y)
        keep = acceptor.symbol[s] != forbidden[which]
        which, s, t = which[keep], s[keep], t[keep]
        after = [(acceptor.target[s], acceptor.target[t], ix[which] + acceptor.before[s], iy[which] + acceptor.before[t], np.full(len(s), _NO_SYMBOL))]
        # An inserted symbol: the longer word moves, and the shorter one does not go on with that symbol.
        which, t = acceptor.leave(b)
        end = a[which] == 0
        rest = ~end
        there = ib[which] + acceptor.before[t]
        at_end = end & open_end[ia[which]] & (acceptor.target[t] == 0)
        found.append((ia[which][at_end], there[at_end]))
        after.append((a[which][rest], acceptor.target[t][rest], ia[which][rest], there[rest], acceptor.symbol[t][rest]))
        # A replaced symbol: two arcs of one state.
        which, s = acceptor.leave(p)
        last = acceptor.first[p] + acceptor.arcs[p]
        later = last[which] - s - 1
        one = np.repeat(np.arange(len(s)), later)
        other = s[one] + 1 + np.arange(len(one)) - (np.cumsum(later) - later)[one]
        base = i[which][one]
        after.append((acceptor.target[s[one]], acceptor.target[other], base + acceptor.before[s[one]], base + acceptor.before[other], np.full(len(one), _NO_SYMBOL)))
        p, i = acceptor.target[s], i[which] + acceptor.before[s]
        which, s, t = acceptor.both(a, b)
        a, b, ia, ib = acceptor.target[s], acceptor.target[t], ia[which] + acceptor.before[s], ib[which] + acceptor.before[t]
        x, y, ix, iy, forbidden = (np.concatenate(column) for column in zip(*after, strict=True))
    first, second = zip(*found, strict=True) if found else ((none,), (none,))
    return np.concatenate(first), np.concatenate(second)


def _points(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts as rows of a matrix, and their number."""
    strings = texts.to_pylist()
    lengths = np.array([len(x) for x in strings], dtype=np.int64)
    every = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    matrix = np.zeros((len(strings), max(width, 1)), dtype=np.uint32)
    matrix[np.arange(max(width, 1)) < lengths[:, None]] = every
    return matrix, lengths


def compose_rows(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs among whole partitions, sorted by key, role and rest, as row numbers."""
    rest = rows.column("rest").combine_chunks()
    width = max((len(x) for x in rest.to_pylist()), default=0)
    symbols, lengths = _points(rest, width)
    longer = rows.column("longer").to_numpy()
    key = rows.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
    new_key = np.r_[True, key[1:] != key[:-1]]
    new_root = new_key | np.r_[True, longer[1:] != longer[:-1]]
    acceptor = Acceptor(symbols, lengths, np.flatnonzero(new_root))
    partition = np.cumsum(new_key) - 1
    roots = np.full((2, partition[-1] + 1), -1, dtype=np.int64)
    at = np.flatnonzero(new_root)
    roots[longer[at], partition[at]] = at
    open_end = rows.column("high").to_numpy() == rows.column("shorter").to_numpy()
    return compose(acceptor, roots[0], roots[1], open_end)


def _add_up(rows: pa.Table) -> pa.RecordBatch:
    """Of each word with near pairs here: how many, and its most frequent near word."""
    a, b = compose_rows(rows)
    word, near = np.concatenate([a, b]), np.concatenate([b, a])
    n = rows.column("n").to_numpy()
    used, which = np.unique(np.concatenate([word, near]), return_inverse=True)
    names = rows.column("word").take(pa.array(used)).to_pylist()
    order = {name: k for k, name in enumerate(sorted(set(names)))}
    rank = np.array([order[name] for name in names], dtype=np.int64)
    word_rank, near_rank = rank[which[: len(word)]], rank[which[len(word) :]]
    by = np.lexsort((near_rank, -n[near], word_rank))
    begins = np.flatnonzero(np.r_[True, word_rank[by][1:] != word_rank[by][:-1]]) if len(by) else by
    best = by[begins]
    counts = np.diff(np.append(begins, len(by)))
    return pa.RecordBatch.from_arrays(
        [
            rows.column("word").take(pa.array(word[best])).combine_chunks(),
            pa.array(counts, pa.int64()),
            pa.array(n[near[best]], pa.int64()),
            rows.column("word").take(pa.array(near[best])).combine_chunks(),
        ],
        names=["word", "n_near", "form_n", "form"],
    )


def _whole_partitions(batches: Batches) -> Iterator[pa.Table]:
    """Sorted rows cut between partitions into tables of about ``BATCH_SYMBOLS`` symbols."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        longest = batch.column("high").to_numpy() - batch.column("low").to_numpy()
        size += batch.num_rows * (int(longest.max()) + 1)
        if size < BATCH_SYMBOLS:
            continue
        rows = pa.Table.from_batches(held)
        key = rows.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        changes = np.flatnonzero(key[1:] != key[:-1]) + 1
        if len(changes):
            yield rows.slice(0, int(changes[-1]))
            held = rows.slice(int(changes[-1])).combine_chunks().to_batches()
            size = sum(x.num_rows for x in held) * (int(longest.max()) + 1)
    if held:
        yield pa.Table.from_batches(held)


def _compose_all(batches: Batches) -> Batches:
    for rows in _whole_partitions(batches):
        yield _add_up(rows)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) of every word of a table (word, n) that has a near word."""
    rows = partitions(words).repartition("key").sortWithinPartitions("key", "longer", "rest")
    parts = rows.mapInArrow(_compose_all, NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("order"), "form"))
    total = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return total.select("word", "n_near", (-F.col("best.order")).alias("form_n"), F.col("best.form").alias("form"))


# --- groups --------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form): where the forms lead.

    The length of the steps doubles each round.  Forms are twice as frequent as their variants, so a
    chain has at most 63 steps and six rounds reach its end.
    """
    current = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = materialise(current.join(further, "root", "left"), "roots")
        current = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.where("next is not null").isEmpty():
            return current


def group_variants(words: DataFrame) -> DataFrame:
    """Per word of a table (word, n): form, root, n, n_near and form_n."""
    words = materialise(words.select("word", "n"), "vocabulary")
    near = words.join(near_words(words), "word", "left")
    is_form = F.col("form_n") >= FORM_TIMES * F.col("n")
    formed = materialise(
        near.select(
            "word",
            F.when(is_form, F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def variants_of_documents(documents: DataFrame) -> DataFrame:
    """The vocabulary of all documents with its forms and roots."""
    return group_variants(vocabulary(documents))
