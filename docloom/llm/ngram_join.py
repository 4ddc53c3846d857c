"""Documents whose sets of word n-grams have a Jaccard similarity of at least 0.85.

The document by n-gram incidence matrix is multiplied with its transpose block by block:

1. Documents with equal sets are one class.
2. Two sets of sizes s <= t can only link when s >= 0.85 t and at most ``differences(t)`` n-grams
   stand in one of them alone.  With the n-grams dealt over more parts than that, at least one
   part is equal in both.  Part hashes that occur in two classes (see :mod:`sieve`) make groups.
3. Many classes share a part by chance, a frequent phrase for instance.  A sketch has a bit or two for each
   n-gram of a set, and two sketches never differ in more bits than their sets do in n-grams: it
   tells of most pairs of a group that they cannot link.  The others are edges; outside their
   connected components no overlap can reach the bound.
4. The rows of a component are cut into blocks of about ``BLOCK`` classes or ``BLOCK_BYTES`` at most, those of a
   large component by size band, of which only neighbours meet.  Each pair of blocks that meet
   is one sparse product: overlap counts are added n-gram by n-gram, pairs under the size bound
   are discarded, and of the links only a spanning forest leaves the task.
5. The forests of all block pairs give the components of the links.

Rows of pairs are never made, no list is capped, and a set is sent to the blocks of its own
component only.

Defined cases: a text without words and a null text have an empty set and link with nothing; rows
with equal sets are linked whatever their ids; a row without ``doc_id`` takes part but can't name
a component; a component of such rows alone has a null id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import sieve, words
from docloom.llm.components import connected
from docloom.llm.packing import pack_sorted, unpack_sorted
from docloom.session import materialise

Batches = Iterator[pa.RecordBatch]

#: Classes and bytes of sets that a block is expected to hold at most.
BLOCK, BLOCK_BYTES = 2048, 12 << 20
#: Classes with a common part up to which each pair of them is looked at once for all parts, and
#: how many of a larger group meet at a time.
FEW_CLASSES, GROUP_BLOCK = 16, 4096
#: Bytes of sketches compared at a time.
SKETCH_BYTES = 4 << 20
#: Blocks up to which a component is not cut by size bands.
FEW_BLOCKS = 3
#: Least share of parts beyond those needed, for parts that are empty.
LEAST_SPARE_PERCENT = 3
#: Deals after which an empty part is a key as well.
MOST_DEALS = 12

_NONE = np.empty(0, dtype=np.int64)


class Rule:
    """n-gram size and the least similarity in hundredths."""

    def __init__(self, gram: int = 4, percent: int = 85):
        self.gram, self.percent = gram, percent
        self.spare_percent = LEAST_SPARE_PERCENT
        while self.spare_percent < 100 and self._empty_percent() * 3 > self.spare_percent * 2:
            self.spare_percent += 1

    def _empty_percent(self) -> float:
        """Share of parts expected empty for a set that is the smallest of its size band.

        It is dealt for the top of the band above, where it has the fewest members a part.  Where more
        parts are empty than are to spare a set is dealt anew, which costs as many keys again.
        """
        needed = 2 * (100 - self.percent) / (100 + self.percent) * (100 / self.percent) ** 2
        return 100 * math.exp(-1 / (needed * (1 + self.spare_percent / 100)))

    def linked(self, overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * overlap >= self.percent * (a + b - overlap)

    def may_link(self, differing: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets of sizes a and b can link when at least so many n-grams stand in one of them alone."""
        return (100 + self.percent) * differing <= (100 - self.percent) * (a + b)

    def band(self, size: int) -> int:
        """Number of the size band; linked sizes differ by one band at most."""
        at, top = 0, 1
        while top < size:
            top = max(top + 1, top * 100 // self.percent)
            at += 1
        return at

    def band_top(self, band: int) -> int:
        top = 1
        for _ in range(band):
            top = max(top + 1, top * 100 // self.percent)
        return top

    def band_tops(self) -> list[int]:
        """The largest sizes of all bands."""
        tops = [1]
        while tops[-1] < 1 << 40:
            tops.append(max(tops[-1] + 1, tops[-1] * 100 // self.percent))
        return tops

    def differences(self, larger: int) -> int:
        """Most n-grams that stand in one of two linked sets alone, for sizes up to ``larger``.

        With overlap o and sizes s <= t: o >= p (s + t) / (1 + p), so s + t - 2 o is at most
        (s + t) (1 - p) / (1 + p), and s + t is at most 2 t.
        """
        return 2 * larger * (100 - self.percent) // (100 + self.percent)


def text_sets(batch: pa.RecordBatch, rule: Rule) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of a batch with the sorted distinct n-gram hashes of each row."""
    for rows, found in words.chunks(batch, "text", lower=True):
        at, grams = found.window_hashes(rule.gram)
        limits = np.searchsorted(found.text_of[at], np.arange(rows.num_rows + 1))
        counts, wholes = found.counts(), found.text_hashes()
        sets = []
        for i in range(rows.num_rows):
            if counts[i] == 0:
                sets.append(np.empty(0, dtype=np.uint64))
            elif counts[i] < rule.gram:
                sets.append(wholes[i : i + 1])
            else:
                sets.append(np.unique(grams[limits[i] : limits[i + 1]]))
        yield rows, sets


def set_hash(grams: np.ndarray) -> int:
    """An order-free hash of a whole set: the sum of its mixed members, mixed with the size."""
    with np.errstate(over="ignore"):
        total = words.mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        return int(words.signed(words.mix(np.array([total + np.uint64(len(grams))], dtype=np.uint64)))[0])


def sketch(grams: np.ndarray) -> bytes:
    """For each value of the members' low bits whether an odd number of members have it, at least one bit a member."""
    bits = max(64, 1 << max(len(grams) - 1, 0).bit_length())
    counts = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """The sketches of some rows and the sizes of their sets."""

    def __init__(self, sketches: list[bytes], sizes: np.ndarray, rule: Rule):
        self.words = np.frombuffer(b"".join(sketches), dtype="<u8")
        self.widths = np.array([len(s) // 8 for s in sketches], dtype=np.int64)
        self.starts = np.cumsum(self.widths) - self.widths
        self.sizes, self.rule = sizes, rule

    def _folded(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Sketches of ``width`` words: what a wider one has further on is added to the same low bits."""
        at = np.arange(width)
        found = self.words[self.starts[rows][:, None] + at]
        for fold in range(1, int(self.widths[rows].max()) // width):
            wider = np.flatnonzero(self.widths[rows] > fold * width)
            found[wider] ^= self.words[self.starts[rows[wider]][:, None] + fold * width + at]
        return found

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of rows, whether their sets can link as far as sizes and sketches tell."""
        possible = self.rule.may_link(np.abs(self.sizes[a] - self.sizes[b]), self.sizes[a], self.sizes[b])
        narrow = np.where(possible, np.minimum(self.widths[a], self.widths[b]), 0)
        for width in np.unique(narrow[narrow > 0]).tolist():
            pairs = np.flatnonzero(narrow == width)
            step = max(1, SKETCH_BYTES // (8 * width))
            for start in range(0, len(pairs), step):
                some = pairs[start : start + step]
                odd = self._folded(a[some], width) ^ self._folded(b[some], width)
                differing = np.bitwise_count(odd).sum(axis=1, dtype=np.int64)
                possible[some] = self.rule.may_link(differing, self.sizes[a[some]], self.sizes[b[some]])
        return possible

    def tree(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that may link and connect what all such pairs of the rows connect, one row against all others at a time."""
        part = np.arange(len(rows))
        for k in range(len(rows) - 1):
            other = k + 1 + np.flatnonzero(part[k + 1 :] != part[k])
            if len(other) == 0:
                continue
            hit = other[self.may_link(np.repeat(rows[k], len(other)), rows[other])]
            _, once = np.unique(part[hit], return_index=True)
            yield np.repeat(rows[k], len(once)), rows[hit[once]]
            part[np.isin(part, part[hit])] = part[k]
            if (part == part[k]).all():
                return


def signatures(grams: np.ndarray, rule: Rule, bands: dict[int, int]) -> np.ndarray:
    """Part hashes of a set, for its own size band and the one above."""
    size = len(grams)
    if size == 0:
        return grams
    own = bands.get(size)
    if own is None:
        own = bands[size] = rule.band(size)
    keys: list[np.ndarray] = []
    for band in (own, own + 1):
        needed = rule.differences(rule.band_top(band)) + 1
        _deal(grams, needed, needed * rule.spare_percent // 100, words.mix(np.array([band], dtype=np.uint64)), keys)
    return np.concatenate(keys)


def _deal(members: np.ndarray, needed: int, spare: int, tag: np.ndarray, keys: list[np.ndarray]) -> None:
    """Deal sorted members over needed + spare parts and add the hash of each part that has any.

    Two linked sets agree on at least spare + 1 parts, so on one with members unless more than
    ``spare`` parts are empty in both.  A set with that many empty parts is dealt anew by other
    hashes, and so is its partner, until they agree.
    """
    parts = needed + spare
    for deal in range(MOST_DEALS):
        part_of = ((members >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        limits = np.searchsorted(part_of, np.arange(parts + 1, dtype=np.uint64))
        sums = np.zeros(len(members) + 1, dtype=np.uint64)
        np.cumsum(words.mix(members), out=sums[1:])
        tags = words.mix(np.arange(1, parts + 1, dtype=np.uint64) ^ words.mix(tag + np.uint64(deal)))
        full = limits[1:] > limits[:-1]
        enough = parts - np.count_nonzero(full) <= spare
        if deal == MOST_DEALS - 1:
            full[:] = True
        keys.append(words.mix((sums[limits[1:]] - sums[limits[:-1]])[full] ^ tags[full]))
        if enough:
            break
        members = np.sort(words.mix(members + np.uint64(1)))


def _facts(rule: Rule) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for rows, sets in text_sets(batch, rule):
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        rows.column("text_hash"),
                        pa.array([len(s) for s in sets], type=pa.int64()),
                        pa.array([set_hash(s) for s in sets], type=pa.int64()),
                        pa.array([sketch(s) for s in sets], type=pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "class", "sketch"],
                )

    return run


def _first_sets(batch: pa.RecordBatch, rule: Rule, first: Broadcast) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Names and sets of the rows that may be the first of their class, empty ones left out."""
    for rows, sets in text_sets(batch, rule):
        names = np.array([set_hash(s) for s in sets], dtype=np.int64)
        own = sieve.passes(first.value, sieve.row_keys(names, rows.column("doc_id")))
        at = [i for i in np.flatnonzero(own).tolist() if len(sets[i])]
        yield [int(names[i]) for i in at], [sets[i] for i in at]


def _signature_rows(rule: Rule, first: Broadcast) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        bands: dict[int, int] = {}
        for batch in batches:
            for names, sets in _first_sets(batch, rule, first):
                keys = [_NONE.view(np.uint64), *(signatures(s, rule, bands) for s in sets)]
                owners = np.repeat(np.array([0, *names], dtype=np.int64), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.signed(np.concatenate(keys))), pa.array(owners)], names=["key", "owner"]
                )

    return run


def _incidence(rule: Rule, first: Broadcast, shared: Broadcast) -> Callable[[Batches], Batches]:
    """(class, key) for the part hashes that may stand in two classes."""

    def run(batches: Batches) -> Batches:
        bands: dict[int, int] = {}
        for batch in batches:
            for names, sets in _first_sets(batch, rule, first):
                keys = [signatures(s, rule, bands) for s in sets]
                hits = [words.signed(k[sieve.passes(shared.value, k)]) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array(names, dtype=np.int64), [len(h) for h in hits])),
                        pa.array(np.concatenate([_NONE, *hits])),
                    ],
                    names=["class", "key"],
                )

    return run


def groups(incidence: DataFrame) -> DataFrame:
    """``group, class``: classes that have a common part, each two of them in one group at least.

    Where few classes share a part each pair is a group, once for all parts that the two share.  A larger
    group is cut into blocks, of which each two meet.
    """
    several = (
        incidence.groupBy("key")
        .agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count("*").alias("n_classes"))
        .where(F.col("least") < F.col("most"))
        .select("key", "n_classes")
    )
    # hashes that come again are short in a file: Spark would take the table for a small one and broadcast it
    shared = incidence.join(several.hint("merge"), "key")
    few = shared.where(F.col("n_classes") <= FEW_CLASSES).groupBy("key").agg(F.array_sort(F.collect_set("class")).alias("own"))
    pairs = (
        few.select("own", F.posexplode("own").alias("at", "a"))
        .select("a", F.explode(F.slice("own", F.col("at") + 2, FEW_CLASSES)).alias("b"))
        .distinct()
    )
    blocks = F.ceil(F.col("n_classes") / GROUP_BLOCK)
    many = (
        shared.where(F.col("n_classes") > FEW_CLASSES)
        .withColumn("block", F.pmod(F.xxhash64("class"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("group"), "class")
    )
    return pairs.select(F.xxhash64("a", "b").alias("group"), F.explode(F.array("a", "b")).alias("class")).union(many)


def _possible_links(rule: Rule) -> Callable[[Batches], Batches]:
    """Of rows that lie by group, edges that connect what all pairs within groups that may link connect."""

    def edges(rows: pa.Table) -> pa.RecordBatch:
        group, classes = rows.column("group").to_numpy(), rows.column("class").to_numpy()
        sketches = Sketches(rows.column("sketch").to_pylist(), rows.column("n_grams").to_numpy(), rule)
        limits = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)]
        found = [_NONE, _NONE]
        firsts = limits[:-1][np.diff(limits) == 2]
        hits = firsts[sketches.may_link(firsts, firsts + 1)]
        found += [hits, hits + 1]
        for k in np.flatnonzero(np.diff(limits) > 2):
            for some in sketches.tree(np.arange(limits[k], limits[k + 1])):
                found += some
        a, b = classes[np.concatenate(found[::2])], classes[np.concatenate(found[1::2])]
        a, b = a[a != b], b[a != b]
        needed = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a[needed], pa.int64()), pa.array(b[needed], pa.int64())], names=["a", "b"])

    def run(batches: Batches) -> Batches:
        last: list[pa.RecordBatch] = []
        for batch in batches:
            group = batch.column("group").to_numpy()
            if len(group) == 0:
                continue
            if last and group[0] == last[0].column("group")[0].as_py() and group[0] == group[-1]:
                last.append(batch)
                continue
            start = int(np.flatnonzero(group == group[-1])[0])
            if last or start:
                yield edges(pa.Table.from_batches([*last, batch.slice(0, start)]))
            last = [batch.slice(start)]
        if last:
            yield edges(pa.Table.from_batches(last))

    return run


def possible_links(incidence: DataFrame, facts: DataFrame, rule: Rule) -> DataFrame:
    """Edges (a, b) that connect what all pairs of classes connect that share a part and may link by their sketches."""
    # pairs by the million are a small file, see groups
    members = materialise(groups(incidence), "groups").hint("merge")
    sketched = (
        facts.join(members.select("class"), "class", "left_semi")
        .groupBy("class")
        .agg(F.max("n_shingles").alias("n_grams"), F.first("sketch").alias("sketch"))
    )
    dealt = members.join(sketched, "class").repartition("group").sortWithinPartitions("group")
    return dealt.select("group", "class", "n_grams", "sketch").mapInArrow(_possible_links(rule), "a long, b long")


def _wanted_sets(rule: Rule, wanted: Broadcast) -> Callable[[Batches], Batches]:
    """The sets of the classes that may be wanted, from their first rows.

    A few other rows may pass the map: a block sees to it that a class counts once.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for names, sets in _first_sets(batch, rule, wanted):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array([pack_sorted(s) for s in sets], type=pa.binary())],
                    names=["class", "grams"],
                )

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The product of two blocks of the incidence matrix: overlap counts of all their rows.

    Only n-grams that stand in both blocks count; they are taken in slices of columns, so the
    dense pieces stay small.
    """
    own, other = np.unique(np.concatenate(left)), np.unique(np.concatenate(right))
    at = np.minimum(np.searchsorted(other, own), len(other) - 1)
    columns = own[other[at] == own]
    counts = np.zeros((len(left), len(right)), dtype=np.int32)
    for start in range(0, len(columns), 2048):
        some = columns[start : start + 2048]
        other_dense = _dense(right, some).T
        for row in range(0, len(left), 256):
            piece = counts[row : row + 256]
            np.add(piece, _dense(left[row : row + 256], some) @ other_dense, out=piece, casting="unsafe")
    return counts


def _dense(rows: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    piece = np.zeros((len(rows), len(columns)), dtype=np.float32)
    for i, row in enumerate(rows):
        own = row[np.searchsorted(row, columns[0]) : np.searchsorted(row, columns[-1], side="right")]
        at = np.searchsorted(columns, own)
        piece[i, at[columns[at] == own]] = 1
    return piece


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the edges (a, b) are needed to connect what all of them connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    needed = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            needed.append(k)
    return needed


def _product(rule: Rule) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # what earlier groups and stages have left in this worker
        _, once = np.unique(np.stack([table.column("block").to_numpy(), table.column("class").to_numpy()]), axis=1, return_index=True)
        if len(once) < table.num_rows:
            table = table.take(pa.array(np.sort(once)))
        classes = table.column("class").to_numpy()
        sets = [unpack_sorted(x.as_py()) for x in table.column("grams")]
        block = table.column("block").to_numpy()
        first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        rows, columns = np.flatnonzero(block == first), np.flatnonzero(block == second)
        if len(rows) == 0 or len(columns) == 0:
            a = b = np.empty(0, dtype=np.int64)
        else:
            counts = overlaps([sets[i] for i in rows], [sets[i] for i in columns])
            found = [_NONE, _NONE]
            for start in range(0, len(rows), 128):
                some = counts[start : start + 128].astype(np.int64)
                x, y = np.nonzero(rule.linked(some, sizes[rows[start : start + 128]][:, None], sizes[columns][None, :]))
                found += [classes[rows[start + x]], classes[columns[y]]]
            a, b = np.concatenate(found[::2]), np.concatenate(found[1::2])
            a, b = a[a != b], b[a != b]
        needed = forest(a, b)
        return pa.table({"a": pa.array(a[needed], pa.int64()), "b": pa.array(b[needed], pa.int64())})

    return run


def places(sized: DataFrame, rule: Rule) -> DataFrame:
    """``class, root, block, others``: the block of each class, and the blocks of its component that it has to meet.

    A component of many blocks is cut by size bands first: linked sizes differ by one band at most, so
    a set meets the blocks of its own band and of its two neighbours.  ``sized`` has class, root, n_grams.
    """
    blocks = F.greatest(F.ceil(F.sum(F.col("n_grams") * 8) / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK)).cast("int")
    large = sized.groupBy("root").agg(blocks.alias("all_blocks"))
    tops = F.array(*[F.lit(t).cast("long") for t in rule.band_tops()])
    band = F.size(F.filter(tops, lambda top: top < F.col("n_grams")))
    parted = sized.join(large, "root").withColumn("part", F.when(F.col("all_blocks") > FEW_BLOCKS, band).otherwise(0))
    parts = materialise(parted.groupBy("root", "part").agg(blocks.alias("blocks")), "parts")
    near = parts.select("root", F.col("part").alias("other_part"), F.col("blocks").alias("other_blocks"))
    numbers = F.sequence(F.lit(0).cast("long"), F.col("other_blocks").cast("long") - 1)
    names = F.transform(numbers, lambda n: F.shiftleft(F.col("other_part").cast("long"), 32) + n)
    around = (
        parts.join(near, "root")
        .where(F.abs(F.col("part") - F.col("other_part")) <= 1)
        .groupBy("root", "part", "blocks")
        .agg(F.flatten(F.collect_list(names)).alias("others"))
    )
    return parted.join(around, ["root", "part"]).select(
        "class",
        "root",
        (F.shiftleft(F.col("part").cast("long"), 32) + F.pmod(F.xxhash64("class"), F.col("blocks"))).alias("block"),
        "others",
    )


def links(texts: DataFrame, facts: DataFrame, rule: Rule) -> DataFrame:
    """Edges (a, b) between classes that connect what all links between different sets connect."""
    first = sieve.firsts(facts.where("n_shingles > 0"), "class")
    shared = sieve.shared_bitmap(texts, _signature_rows(rule, first))
    incidence = materialise(texts.mapInArrow(_incidence(rule, first, shared), "class long, key long"), "incidence")
    edges = possible_links(incidence, facts, rule)
    component = materialise(connected(edges), "blocks")
    members = component.select(F.col("node").alias("class"))
    wanted = sieve.firsts(facts.join(members, "class", "left_semi"), "class")
    candidates = texts.mapInArrow(_wanted_sets(rule, wanted), "class long, grams binary")
    lengths = facts.join(members, "class", "left_semi").groupBy("class").agg(F.max("n_shingles").alias("n_grams"))
    sized = component.withColumnRenamed("node", "class").join(lengths, "class")
    placed = (
        candidates.join(places(sized, rule), "class")
        .withColumn("other", F.explode("others"))
        .select(
            "root",
            F.least("block", "other").alias("first"),
            F.greatest("block", "other").alias("second"),
            "block",
            "class",
            "grams",
        )
    )
    return placed.groupBy("root", "first", "second").applyInArrow(_product(rule), "a long, b long")


def classes(documents: DataFrame, rule: Rule | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n_shingles, class, sketch) of every row, and (class, root) of the linked classes."""
    rule = rule or Rule()
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    facts = materialise(
        hashed.mapInArrow(_facts(rule), "doc_id long, text_hash long, n_shingles long, class long, sketch binary"), "facts"
    )
    roots = connected(links(texts, facts, rule)).select(F.col("node").alias("class"), "root")
    return facts, roots


def components(documents: DataFrame, rule: Rule | None = None) -> DataFrame:
    """Per row doc_id, text_hash, n_shingles and component_id."""
    facts, roots = classes(documents, rule)
    by_class = facts.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    named = by_class.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(of_root, "root").select("class", "component_id")
    return facts.join(of_class, "class", "left").select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def join_documents(documents: DataFrame, rule: Rule | None = None) -> DataFrame:
    """Per row doc_id, n_shingles and component_id, the least doc_id reachable by links."""
    return components(documents, rule).drop("text_hash")


def keep_first(documents: DataFrame, rule: Rule | None = None) -> DataFrame:
    """All columns of the rows that stay: of each group of linked rows those with its least id.

    Rows without words stay.  Rows that repeat the id and the text of the row that stays are that
    document again and stay too.  Of a group without any id all rows stay, since none can be told
    to be the first.
    """
    gone = (
        components(documents, rule)
        .where("n_shingles > 0 and component_id is not null and not doc_id <=> component_id")
        .select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
        .distinct()
    )
    # as a table its size is known beforehand, so whole texts are only shuffled where it is large
    gone = materialise(gone, "gone")
    same = documents["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (
        F.xxhash64(documents["text"]) == gone["gone_hash"]
    )
    return documents.join(gone, same, "left_anti")
