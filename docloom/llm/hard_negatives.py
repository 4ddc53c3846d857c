"""Hard negatives of anchors by inner product, searched in R-trees packed sort-tile-recursively.

1. Rows of one label are tiled in Spark: each level sorts by one more coordinate and cuts every slab at
   quantiles, until a tile holds about ``TILE_ROWS`` rows; slabs that no quantile divides (equal vectors)
   are dealt by id.  A task packs one tile: pages of ``PAGE_ROWS`` rows by the same recursion over the
   next coordinates, and boxes over ``FANOUT`` boxes up to a root.
2. Anchors are packed into blocks of at most ``BLOCK_ANCHORS`` of one label.  A block and a tile meet in
   one group of two rows; a row of a pair of vectors is never made, nothing is broadcast.
3. In a group every anchor searches the tree: a box gives an interval for each coordinate's product and
   so for the inner product.  A queue opens the most promising box first; boxes outside all score windows,
   or strictly below the k-th best of every window they meet, are dropped (equal scores stay, for ids).
   Blocks of anchors have boxes too: tiles whose interval with a block misses every window are not sent.
4. The best of all tiles are ranked by (score descending, id).

The first search, among tiles of the anchor's label, finds positives; the second, among all others,
finds the negatives within each positive's window.

Defined cases: rows with a null label, vector or component, or one that is not finite, take no part, nor
do rows without id; missing components of a shorter vector are zeros; an anchor leaves out itself, once,
so repeated rows are other rows; scaled components beyond 2**62 and scores beyond 2**63 - 1 count as that
limit; columns besides vec_id, embedding and label are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.session import materialise

Batches = Iterator[pa.RecordBatch]

SCALE = 256
LABELS = 10
ANCHOR_EVERY = 100
MOVED_EVERY = 7
POSITIVES = NEGATIVES = 5
#: Least share of the positive's score that a hard negative has, in hundredths.
WINDOW_PERCENT = 80

TILE_ROWS = 4096
TILE_BYTES = 4 << 20
PAGE_ROWS = 64
FANOUT = 16
BLOCK_ANCHORS = 512
MOST_SLABS = 8
LANES = 16

_EXACT = 2**53
_LARGEST = 2.0**62
#: Just within 64 bits as a floating-point number; scores end at the limit.
_SCORE_LIMIT = 2.0**63 - 1024

TILE = "label int, tile long, low array<long>, high array<long>, tree binary"
BLOCK = "label int, block long, low array<long>, high array<long>, least double, most double, anchors binary"


# --- vectors -------------------------------------------------------------------


def clean(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector): moved labels, scaled whole components, rows that take part."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    label = F.when(F.col("vec_id") % MOVED_EVERY == 0, F.pmod(F.col("label") + 1, F.lit(LABELS))).otherwise(F.col("label"))
    return (
        embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
        .where(fine)
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            label.cast("int").alias("label"),
            F.transform(values, lambda x: F.floor(F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), x * SCALE))).cast("long")).alias("vector"),
        )
    )


def matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy().astype(np.int64) if len(column) else np.empty(0, dtype=np.int64)
    width = int(lengths.max(initial=0)) if width is None else width
    out = np.zeros((len(column), max(width, 1)), dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def widen(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, max(0, width - rows.shape[1]))))


def products(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point where all sums stay below 2**53, else by whole numbers."""
    bound = int(np.abs(rows).max(initial=0)) * int(np.abs(vector).max(initial=0)) * max(len(vector), 1)
    if bound < _EXACT:
        return (rows.astype(np.float64) @ vector.astype(np.float64)).astype(np.int64)
    if bound < 2**63:
        return rows @ vector
    return np.clip(rows.astype(object) @ vector.astype(object), 1 - 2**63, 2**63 - 1).astype(np.int64)


def save(**arrays: np.ndarray) -> bytes:
    """Arrays in the smallest whole-number type that holds them."""
    body, head = [], []
    for name, values in arrays.items():
        kind = next((t for t in ("<i1", "<i2", "<i4") if not values.size or (values.min() >= np.iinfo(t).min and values.max() <= np.iinfo(t).max)), "<i8")
        raw = np.ascontiguousarray(values, dtype=kind).tobytes()
        head.append(f"{name},{kind},{'x'.join(map(str, values.shape))},{len(raw)}")
        body.append(raw)
    return ";".join(head).encode() + b"\n" + b"".join(body)


def load(data: bytes) -> dict[str, np.ndarray]:
    head, _, body = data.partition(b"\n")
    out, at = {}, 0
    for entry in head.decode().split(";"):
        name, kind, shape, size = entry.split(",")
        values = np.frombuffer(body, dtype=kind, count=int(size) // int(kind[2]), offset=at)
        out[name] = values.reshape([int(x) for x in shape.split("x")]).astype(np.int64)
        at += int(size)
    return out


# --- packing -------------------------------------------------------------------


def tile_order(rows: np.ndarray, page: int, first: int = 0) -> np.ndarray:
    """Sort-tile-recursive order of rows into pages, beginning with the given coordinate."""
    dims = rows.shape[1]

    def pack(at: np.ndarray, dim: int, left: int) -> list[np.ndarray]:
        pages = -(-len(at) // page)
        if pages <= 1 or left == 0:
            return [at]
        at = at[np.argsort(rows[at, dim % dims], kind="stable")]
        slabs = max(2, math.ceil(pages ** (1 / left)))
        size = -(-pages // slabs) * page
        return [x for k in range(0, len(at), size) for x in pack(at[k : k + size], dim + 1, left - 1)]

    return np.concatenate(pack(np.arange(len(rows)), first, max(dims, 1)))


class Tree:
    """Boxes over pages of vectors, level by level; the last level is the root."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        starts = np.arange(0, len(rows), PAGE_ROWS)
        low, high = np.minimum.reduceat(rows, starts), np.maximum.reduceat(rows, starts)
        self.levels = [(low, high)]
        while len(low) > 1:
            starts = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.levels.append((low, high))
        self.floats = [(a.astype(np.float64), b.astype(np.float64)) for a, b in self.levels]
        self.float_rows = rows.astype(np.float64)
        self.largest = int(np.abs(rows).max(initial=0))

    def interval(self, level: int, at: slice, up: np.ndarray, down: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of boxes with a vector's positive and negative parts."""
        low, high = self.floats[level]
        least, most = low[at] @ up + high[at] @ down - slack, high[at] @ up + low[at] @ down + slack
        return np.minimum(least, _SCORE_LIMIT), np.maximum(most, -_SCORE_LIMIT)

    def search(self, vector: np.ndarray, windows: list[Window]) -> None:
        """Offer the windows all rows that may be among their best, the most promising box first."""
        up, down = np.maximum(vector, 0).astype(np.float64), np.minimum(vector, 0).astype(np.float64)
        size = self.largest * int(np.abs(vector).max(initial=0)) * max(len(vector), 1)
        exact = size < _EXACT  # all sums are whole numbers that floating point holds
        slack = 0.0 if exact else size * 2.0**-40
        floats = vector.astype(np.float64)
        queue: list[tuple[float, int, int]] = []

        def offer(level: int, at: slice) -> None:
            least, most = self.interval(level, at, up, down, slack)
            for k, (low, high) in enumerate(zip(least.tolist(), most.tolist(), strict=True), start=at.start):
                if any(window.open_to(low, high) for window in windows):
                    heapq.heappush(queue, (-high, level, k))

        top = len(self.levels) - 1
        offer(top, slice(0, 1))
        while queue:
            high, level, k = heapq.heappop(queue)
            wanted = [window for window in windows if -high >= window.least_useful()]
            if not wanted:
                break  # no later box promises more
            if level:
                offer(level - 1, slice(k * FANOUT, min((k + 1) * FANOUT, len(self.levels[level - 1][0]))))
                continue
            at = slice(k * PAGE_ROWS, (k + 1) * PAGE_ROWS)
            scores = self.float_rows[at] @ floats if exact else products(self.rows[at], vector)
            for window in wanted:
                window.take(scores, self.ids[at])


class Window:
    """The best rows of a range of scores: higher scores first, then smaller ids."""

    def __init__(self, count: int, least: float = -math.inf, most: float = math.inf):
        self.count, self.least, self.most = count, least, most
        self.best: list[tuple[int, int]] = []  # (-score, id), in order

    def least_useful(self) -> float:
        """Scores below cannot enter any more; an equal score can, by a smaller id."""
        return max(self.least, -self.best[-1][0]) if len(self.best) == self.count else self.least

    def open_to(self, low: float, high: float) -> bool:
        return high >= self.least_useful() and low <= self.most

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        at = np.flatnonzero((scores >= self.least_useful()) & (scores <= self.most))
        if len(at):
            new = zip((-scores[at].astype(np.int64)).tolist(), ids[at].tolist(), strict=True)
            self.best = heapq.nsmallest(self.count, [*self.best, *new])


def _box(rows: np.ndarray) -> tuple[list[int], list[int]]:
    return rows.min(axis=0).tolist(), rows.max(axis=0).tolist()


def _pack_tile(levels: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        rows = matrix(table.column("vector"))
        order = tile_order(rows, PAGE_ROWS, levels)
        ids = table.column("vec_id").to_numpy()[order]
        low, high = _box(rows)
        return pa.table(
            {
                "label": pa.array([table.column("label")[0].as_py()], pa.int32()),
                "tile": pa.array([table.column("tile")[0].as_py()], pa.int64()),
                "low": pa.array([low], pa.list_(pa.int64())),
                "high": pa.array([high], pa.list_(pa.int64())),
                "tree": pa.array([save(ids=ids, rows=rows[order])], pa.binary()),
            }
        )

    return run


def _tile_rows(width: int) -> int:
    return max(1, min(TILE_ROWS, TILE_BYTES // (8 * max(width, 1))))


def tiles(rows: DataFrame) -> DataFrame:
    """All rows of (vec_id, label, vector) in packed tiles of one label."""
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    most, width = _tile_rows(size.width or 0), max(size.width or 0, 1)
    wanted = -(-size.n // most)
    levels = min(width, max(0, math.ceil(math.log(max(wanted, 1), MOST_SLABS))))
    slabs = math.ceil(wanted ** (1 / levels)) if levels else 1
    current, slab = rows.withColumn("slab", F.lit(0).cast("long")), ["label", "slab"]
    for level in range(levels):
        at = F.coalesce(F.get("vector", F.lit(level)), F.lit(0))
        shares = F.array(*[F.lit(k / slabs) for k in range(1, slabs)])
        cuts = current.groupBy(*slab).agg(
            F.count("*").alias("in_slab"), F.percentile_approx(at, shares, 10000).alias("cuts")
        )
        place = F.when(F.col("in_slab") > most, F.size(F.filter("cuts", lambda cut: cut < at))).otherwise(0)
        current = current.join(cuts, slab).select("vec_id", "label", "vector", (F.col("slab") * slabs + place).alias("slab"))
    sizes = current.groupBy(*slab).agg(F.count("*").alias("in_slab"))
    parts = F.ceil(F.col("in_slab") / most)
    dealt = current.join(sizes, slab).select(
        "vec_id", "label", "vector", F.xxhash64("label", "slab", F.pmod(F.xxhash64("vec_id", "vector"), parts)).alias("tile")
    )
    return dealt.groupBy("label", "tile").applyInArrow(_pack_tile(levels), TILE)


# --- anchors -------------------------------------------------------------------


def _blocks(batches: Batches) -> Batches:
    """Blocks of the anchors in tiles."""
    for batch in batches:
        for k in range(batch.num_rows):
            tree = load(batch.column("tree")[k].as_py())
            at = np.flatnonzero(tree["ids"] % ANCHOR_EVERY == 0)
            tile = batch.column("tile")[k].as_py()
            for number, start in enumerate(range(0, len(at), BLOCK_ANCHORS)):
                own = at[start : start + BLOCK_ANCHORS]
                low, high = _box(tree["rows"][own])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("label").slice(k, 1),
                        pa.array([tile ^ (number * 0x9E3779B97F4A7C1 & (1 << 62) - 1)], pa.int64()),
                        pa.array([low], pa.list_(pa.int64())),
                        pa.array([high], pa.list_(pa.int64())),
                        pa.array([-math.inf]),
                        pa.array([math.inf]),
                        pa.array([save(ids=tree["ids"][own], rows=tree["rows"][own])], pa.binary()),
                    ],
                    names=["label", "block", "low", "high", "least", "most", "anchors"],
                )


def blocks(packed: DataFrame) -> DataFrame:
    return packed.mapInArrow(_blocks, BLOCK)


def _end_product(greatest: bool) -> Column:
    """Greatest or least inner product of a vector of one box with a vector of the other."""
    sides = F.arrays_zip(F.col("low").alias("a"), F.col("high").alias("b"), F.col("tile_low").alias("c"), F.col("tile_high").alias("d"))
    end = F.greatest if greatest else F.least

    def step(total: Column, x: Column) -> Column:
        a, b, c, d = (F.coalesce(x[k], F.lit(0)).cast("double") for k in "abcd")
        return total + end(a * c, a * d, b * c, b * d)

    return F.aggregate(sides, F.lit(0.0), step)


def meetings(anchors: DataFrame, packed: DataFrame, same_label: bool) -> DataFrame:
    """(label, block, tile) of all blocks and tiles whose inner products may fall into a window.

    Blocks and tiles stand for hundreds of rows.  They meet by label; for other labels tiles are dealt to
    ``LANES`` lanes, and every block goes along all of them.
    """
    box = packed.select(F.col("label").alias("tile_label"), "tile", F.col("low").alias("tile_low"), F.col("high").alias("tile_high"))
    own = anchors.drop("anchors")
    if same_label:
        met = own.withColumn("tile_label", F.col("label")).join(box, "tile_label")
    else:
        lane = F.pmod(F.xxhash64("tile"), F.lit(LANES)).cast("int")
        along = own.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
        met = along.join(box.withColumn("lane", lane), "lane").where("label <> tile_label")
    slack = 1e-9
    least, most = F.least("least", F.lit(_SCORE_LIMIT)), F.greatest("most", F.lit(_SCORE_LIMIT) * -1)
    reach = (_end_product(True) * (1 + slack) + 1 >= least) | (_end_product(True) * (1 - slack) + 1 >= least)
    lowest = F.least(_end_product(False), F.lit(_SCORE_LIMIT))
    under = (lowest * (1 + slack) - 1 <= most) | (lowest * (1 - slack) - 1 <= most)
    return met.where(reach & under).select("block", "tile")


def _search(find: Callable[[dict, Tree], dict], schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """Search one block's anchors in one tile; the group has a row of each."""

    def run(table: pa.Table) -> pa.Table:
        body = dict(zip(table.column("side").to_pylist(), table.column("body").to_pylist(), strict=True))
        if len(body) < 2:
            return schema.empty_table()
        tree, own = load(body["tile"]), load(body["block"])
        width = max(tree["rows"].shape[1], own["rows"].shape[1])
        own["rows"] = widen(own["rows"], width)
        return pa.table(find(own, Tree(tree["ids"], widen(tree["rows"], width))), schema=schema)

    return run


def _meet(anchors: DataFrame, packed: DataFrame, pairs: DataFrame, find: Callable[[dict, Tree], dict], schema: pa.Schema, ddl: str) -> DataFrame:
    pairs = materialise(pairs, "meetings")
    sides = (
        pairs.join(packed.select("tile", F.col("tree").alias("body")), "tile").select("block", "tile", F.lit("tile").alias("side"), "body")
    ).unionByName(
        pairs.join(anchors.select("block", F.col("anchors").alias("body")), "block").select("block", "tile", F.lit("block").alias("side"), "body")
    )
    return sides.groupBy("block", "tile").applyInArrow(_search(find, schema), ddl)


_LONG = pa.int64()
_HITS = pa.schema([("block", _LONG), ("anchor", _LONG), ("slot", _LONG), ("hit", _LONG), ("score", _LONG)])
HITS = "block long, anchor long, slot long, hit long, score long"


def _rows(block: np.ndarray, anchor: list[int], slot: list[int], best: list[tuple[int, int]]) -> dict:
    return {
        "block": np.repeat(block, len(best)),
        "anchor": np.array(anchor, dtype=np.int64),
        "slot": np.array(slot, dtype=np.int64),
        "hit": np.array([i for _, i in best], dtype=np.int64),
        "score": np.array([-s for s, _ in best], dtype=np.int64),
    }


def _find_positives(own: dict, tree: Tree) -> dict:
    """The best rows of the label, the anchor itself among them where it is one of the best."""
    anchor, best = [], []
    for k, vector in enumerate(own["rows"]):
        window = Window(POSITIVES + 1)
        tree.search(vector, [window])
        anchor += [k] * len(window.best)
        best += window.best
    return _rows(own["name"], anchor, [0] * len(anchor), best)


def _find_negatives(own: dict, tree: Tree) -> dict:
    anchor, slot, best = [], [], []
    for k, vector in enumerate(own["rows"]):
        windows = []
        for score in own["scores"][k, : own["found"][k]].tolist():
            # 80 p <= 100 n <= 100 p in whole numbers
            windows.append(Window(NEGATIVES, -(-WINDOW_PERCENT * score // 100), score))
        if windows:
            tree.search(vector, windows)
        for j, window in enumerate(windows):
            anchor += [k] * len(window.best)
            slot += [j] * len(window.best)
            best += window.best
    return _rows(own["name"], anchor, slot, best)


def _ranked(hits: DataFrame, most: int) -> DataFrame:
    order = W.partitionBy("block", "anchor", "slot").orderBy(F.desc("score"), "hit")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def _with_positives(block: pa.Table, hits: pa.Table) -> pa.Table:
    """The blocks with each anchor's positives and their scores, without the anchor itself."""
    own = load(block.column("anchors")[0].as_py())
    count = len(own["ids"])
    ids = np.zeros((count, POSITIVES), dtype=np.int64)
    scores, found = ids.copy(), np.zeros(count, dtype=np.int64)
    at = hits.sort_by([("anchor", "ascending"), ("place", "ascending")])
    anchor, hit, score = (at.column(x).to_numpy() for x in ("anchor", "hit", "score"))
    limits = np.searchsorted(anchor, np.arange(count + 1))
    for k in range(count):
        best = list(zip(score[limits[k] : limits[k + 1]].tolist(), hit[limits[k] : limits[k + 1]].tolist(), strict=True))
        itself = (int(products(own["rows"][k : k + 1], own["rows"][k])[0]), int(own["ids"][k]))
        if itself in best:
            best.remove(itself)
        best = best[:POSITIVES]
        found[k] = len(best)
        for j, (value, other) in enumerate(best):
            ids[k, j], scores[k, j] = other, value
    wanted = np.arange(POSITIVES) < found[:, None]
    least = -(-WINDOW_PERCENT * scores // 100)
    open_ = wanted & (least <= scores)
    return block.drop_columns(["anchors", "least", "most"]).append_column(
        "least", pa.array([float(least[open_].min(initial=2**62))])
    ).append_column("most", pa.array([float(scores[open_].max(initial=-(2**62)))])).append_column(
        "anchors", pa.array([save(name=own["name"], ids=own["ids"], rows=own["rows"], positives=ids, scores=scores, found=found)], pa.binary())
    )


def _name_blocks(batches: Batches) -> Batches:
    """Put the block's number into its body, where the searches read it."""
    for batch in batches:
        bodies = []
        for block, body in zip(batch.column("block").to_pylist(), batch.column("anchors").to_pylist(), strict=True):
            bodies.append(save(name=np.array([block]), **load(body)))
        at = batch.schema.get_field_index("anchors")
        yield batch.set_column(at, "anchors", pa.array(bodies, pa.binary()))


def _positives_of(batches: Batches) -> Batches:
    for batch in batches:
        for body in batch.column("anchors").to_pylist():
            own = load(body)
            k, j = np.nonzero(np.arange(POSITIVES) < own["found"][:, None])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(own["name"], len(k))), pa.array(k), pa.array(j),
                    pa.array(own["ids"][k]), pa.array(own["positives"][k, j]), pa.array(own["scores"][k, j]),
                ],
                names=["block", "anchor", "slot", "anchor_id", "positive_id", "positive_score"],
            )


@dataclass
class Mined:
    """Positives of every anchor, and the hard negatives of every anchor and positive."""

    positives: DataFrame
    negatives: DataFrame


def mine(embeddings: DataFrame) -> Mined:
    """Search a table (vec_id, embedding, label) for the positives and hard negatives of its anchors."""
    packed = materialise(tiles(clean(embeddings)), "tiles")
    anchors = materialise(blocks(packed).mapInArrow(_name_blocks, BLOCK), "anchor-blocks")
    near = _meet(anchors, packed, meetings(anchors, packed, True), _find_positives, _HITS, HITS)
    best = _ranked(near, POSITIVES + 1)
    ready = materialise(
        anchors.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(_with_positives, "label int, block long, low array<long>, high array<long>, least double, most double, anchors binary"),
        "anchors-with-positives",
    )
    positives = ready.mapInArrow(
        _positives_of, "block long, anchor long, slot long, anchor_id long, positive_id long, positive_score long"
    )
    hard = _meet(ready, packed, meetings(ready, packed, False), _find_negatives, _HITS, HITS)
    ranked = _ranked(hard, NEGATIVES)
    negatives = ranked.join(positives, ["block", "anchor", "slot"]).select(
        "anchor_id",
        "positive_id",
        F.col("place").cast("int").alias("rank"),
        F.col("hit").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
    return Mined(positives.select("anchor_id", "positive_id", "positive_score"), negatives)


def mine_negatives(embeddings: DataFrame) -> DataFrame:
    """Per anchor, positive and rank the hard negative with both scores."""
    return mine(embeddings).negatives
