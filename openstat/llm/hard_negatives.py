"""Hard negatives from an R-tree packed by Sort-Tile-Recursive.

Packing: the upper level is fitted on a bounded sample of rows: sorted by the coordinate of the
greatest spread and cut into slabs, each sorted by the next coordinate, and so on, until
there is a tile for each TILE_BYTES of vectors. Every row goes to its tile; a tile that is
larger than planned, by repeated vectors or an unlucky sample, is dealt by hash into parts, so
a tree has a bounded size whatever the data. In a task each part is packed the same way into
leaves, and leaves into nodes of FANOUT, each with its minimum bounding box.

Search: a box gives an interval for every coordinate, thus bounds of the inner product
of an anchor with any row in it, coordinate by coordinate. Anchors of a block run
through a tree together, each with its own best-first queue: the node with the highest
upper bound comes next, its children join the queue or its rows are scored, all anchors
at one leaf at once. A node goes unread if its bounds lie outside every score window of
the anchor, or if its upper bound lies strictly below the k-th score found in every one.
The k best of a part hold for the next. Nothing is left out otherwise, so results are exact.

First the positives of each anchor are searched (best rows of its own label), then the
negatives of each positive within a window of scores. Blocks of anchors meet the parts
of the tree; a task gives the k best per anchor, which are merged by anchor.

Scores are whole numbers, computed exactly. Rows with a null id or label, a null or empty
vector, a null component, or a component above the root of 2**53 / length, whose products would not be exact, take no part.
Vectors are compared with those of their own length. An anchor does not find rows of its
own id; repeated rows are rows of their own, and a repeated anchor (id, label and vector)
counts once. Fewer rows than asked: all. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from openstat.llm.vectors import TopK, blocks, by_length, cells, dealt
from openstat.session import store

#: Rows for the cuts of the upper level, and at most as many tiles as leave this many sampled rows in each.
SAMPLE_ROWS, PER_TILE = 65_536, 32
#: Bytes of vectors in a part, rows in a leaf, children of a node.
TILE_BYTES, LEAF, FANOUT = 16 << 20, 512, 8
#: Largest window of scores.
ANY = (-(1 << 62), 1 << 62)

PACKED_SCHEMA = "id long, label long, vector array<long>, spread long, tile int"
FOUND_SCHEMA = "id long, label long, key long, slot int, found array<struct<worse:long,near:long>>"


def slabs(n_pages: int, dims: int) -> int:
    """Slabs along the next coordinate, for so many pages and coordinates left."""
    return max(2, int(np.ceil(n_pages ** (1 / max(dims, 1)))))


def tiled(x: np.ndarray, coordinates: np.ndarray, n_pages: int) -> list[np.ndarray]:
    """Rows of x in about n_pages pages of equal size, by sorting, cutting and recursing."""

    def cut(rows: np.ndarray, pages: int, k: int) -> Iterator[np.ndarray]:
        if pages <= 1 or len(rows) <= 1:
            yield rows
            return
        rows = rows[np.argsort(x[rows, coordinates[k % len(coordinates)]], kind="stable")]
        parts = min(slabs(pages, len(coordinates) - k), pages)
        for part in np.array_split(rows, parts):
            yield from cut(part, -(-pages // parts), k + 1)

    return [rows for rows in cut(np.arange(len(x)), n_pages, 0) if len(rows)]


class Cuts:
    """Tile boundaries fitted by Sort-Tile-Recursive on sampled rows."""

    def __init__(self, x: np.ndarray, n_tiles: int) -> None:
        self.n = 0
        self.coordinates = np.argsort(-x.astype(float).var(0), kind="stable") if len(x) else np.arange(x.shape[1])
        self.root = self._fit(x, n_tiles, 0)

    def _fit(self, x: np.ndarray, tiles: int, k: int):
        if tiles <= 1 or len(x) < 2 or not x.shape[1]:
            self.n += 1
            return self.n - 1
        at = self.coordinates[k % len(self.coordinates)]
        x = x[np.argsort(x[:, at], kind="stable")]
        parts = min(slabs(tiles, len(self.coordinates) - k), tiles)
        edges = [len(x) * i // parts for i in range(1, parts)]
        below = [self._fit(part, -(-tiles // parts), k + 1) for part in np.split(x, edges)]
        return at, x[edges, at], below

    def tile(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int32)

        def place(node, rows: np.ndarray) -> None:
            if isinstance(node, int):
                out[rows] = node
                return
            at, edges, below = node
            slab = np.searchsorted(edges, x[rows, at], side="right")
            for i, child in enumerate(below):
                if (own := rows[slab == i]).size:
                    place(child, own)

        place(self.root, np.arange(len(x)))
        return out


class Tree:
    """Leaves and nodes over the rows of one part, root first; children follow one another."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        coordinates = np.argsort(-x.var(0), kind="stable")
        pages = tiled(x, coordinates, -(-len(x) // LEAF))
        self.ids, self.labels, self.x = [ids[p] for p in pages], [labels[p] for p in pages], [x[p] for p in pages]
        low, high = np.stack([v.min(0) for v in self.x]), np.stack([v.max(0) for v in self.x])
        levels = [(low, high, None)]
        while len(low) > 1:
            starts = np.arange(0, len(low), FANOUT)
            ends = np.r_[starts[1:], len(low)]
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            levels.append((low, high, np.c_[starts, ends]))
        levels.reverse()
        sizes = [len(level[0]) for level in levels]
        begin = np.cumsum([0, *sizes])
        self.low, self.high = (np.concatenate([level[i] for level in levels]) for i in (0, 1))
        self.children = [level[2] + begin[i + 1] for i, level in enumerate(levels[:-1])]
        self.children = np.concatenate(self.children) if self.children else np.empty((0, 2), np.int64)
        self.first_leaf = int(begin[-2])

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of the inner product of each anchor with the rows under each node."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.high.T + down @ self.low.T, up @ self.low.T + down @ self.high.T


class Anchors:
    """Anchors of one vector length, each with some score windows and the k best rows of each."""

    def __init__(self, ids, labels, keys, x, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> None:
        self.ids, self.labels, self.keys, self.x, self.same = ids, labels, keys, x, same
        self.low, self.high, self.n_windows = low, high, low.shape[1]
        self.top = TopK(low.size, k, np.int64)

    def wanted(self) -> np.ndarray:
        """Lowest score that each window still takes."""
        return np.maximum(self.low, self.top.least.reshape(self.low.shape))

    def search(self, tree: Tree) -> None:
        upper, lower = tree.bounds(self.x)
        queue = np.full(upper.shape, -np.inf)
        queue[:, 0] = upper[:, 0]
        active = np.arange(len(self.x))
        while len(active):
            node = queue[active].argmax(1)
            best = queue[active, node]
            use = (best[:, None] >= self.wanted()[active]) & (lower[active, node][:, None] <= self.high[active])
            # what lies below every window's wanted score ends the queue: all that follow are no higher
            going = (best > -np.inf) & (best[:, None] >= self.wanted()[active]).any(1)
            active, node, use = active[going], node[going], use.any(1)[going]
            queue[active, node] = -np.inf
            rows, nodes = active[use], node[use]
            order = np.argsort(nodes, kind="stable")
            cuts = np.flatnonzero(np.diff(nodes[order], prepend=-1))
            for some in np.split(order, cuts[1:]) if len(order) else ():
                who, at = rows[some], int(nodes[some[0]])
                if at >= tree.first_leaf:
                    self.score(who, at - tree.first_leaf, tree)
                else:
                    a, b = tree.children[at]
                    queue[who, a:b] = upper[who, a:b]

    def score(self, who: np.ndarray, leaf: int, tree: Tree) -> None:
        ids, labels = tree.ids[leaf], tree.labels[leaf]
        scores = self.x[who] @ tree.x[leaf].T
        wanted, high = self.wanted()[who], self.high[who]
        fits = (scores >= wanted.min(1)[:, None]) & (scores <= high.max(1)[:, None])
        fits &= (labels == self.labels[who][:, None]) == self.same
        i, j = np.nonzero(fits)
        mine = self.ids[who[i]] != ids[j]
        i, j = i[mine], j[mine]
        value = scores[i, j].astype(np.int64)
        for window in range(self.n_windows):
            good = (value >= wanted[i, window]) & (value <= high[i, window])
            self.top.add(who[i[good]] * self.n_windows + window, value[good], ids[j[good]])

    def best(self) -> pa.RecordBatch:
        n = self.n_windows
        repeat = lambda v: pa.array(np.repeat(v, n))
        return pa.RecordBatch.from_arrays(
            [
                repeat(self.ids), repeat(self.labels), repeat(self.keys),
                pa.array(np.tile(np.arange(n, dtype=np.int32), len(self.ids))), self.top.lists(),
            ],
            ["id", "label", "key", "slot", "found"],
        )


def _search(k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, tile = None, None
        waiting: list[pa.RecordBatch] = []
        block: dict[int, Anchors] = {}

        def joined() -> pa.Table:
            table = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            return table

        def close() -> None:
            """What has been gathered is the block of anchors, or a part of the tree to search."""
            if not waiting:
                return
            of_anchors = not waiting[0].column(waiting[0].schema.get_field_index("is_row"))[0].as_py()
            table = joined()
            get = lambda c: table[c].combine_chunks()
            ids, labels = get("id").to_numpy(zero_copy_only=False), get("label").to_numpy(zero_copy_only=False)
            for dim, rows, x in by_length(get("vector"), float):
                if of_anchors:
                    keys = get("key").to_numpy(zero_copy_only=False)
                    low, high = (np.stack(get(c).take(pa.array(rows)).to_numpy(zero_copy_only=False)) for c in ("low", "high"))
                    block[dim] = Anchors(ids[rows], labels[rows], keys[rows], x, low, high, k, same)
                elif dim in block:
                    block[dim].search(Tree(ids[rows], labels[rows], x))

        for (at, is_row, part), batch in cells(batches, "cell", "is_row", "part"):
            if (at, is_row, part) != tile:
                close()
                tile = (at, is_row, part)
            if at != cell:
                yield from (b.best() for b in block.values())
                cell = at
                block.clear()
            waiting.append(batch)
        close()
        yield from (b.best() for b in block.values())

    return run


ROW_SCHEMA = "id long, label long, vector array<long>, spread long"


def _sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose vectors take part, each with a random number that is written with it."""
    random = np.random.default_rng()
    for batch in batches:
        vector = batch.column(2)
        sizes = np.asarray(pa.compute.list_value_length(vector).fill_null(0))
        values = vector.flatten()
        with np.errstate(divide="ignore"):
            limit = np.floor(np.sqrt((1 << 53) / sizes))
        row = np.repeat(np.arange(len(sizes)), sizes)
        wide = np.abs(values.fill_null(1 << 62).to_numpy(zero_copy_only=False).astype(float)) > limit[row]
        good = np.flatnonzero((sizes > 0) & (np.bincount(row[wide], minlength=len(sizes)) == 0))
        part = batch.take(pa.array(good))
        yield pa.RecordBatch.from_arrays(
            [*part.columns, pa.array(random.integers(0, 1 << 31, len(good)))], [*batch.schema.names, "spread"]
        )


def usable(df: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    named = df.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull())
    return named.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<long>").alias("vector"),
    ).mapInArrow(_sound, ROW_SCHEMA)


def _place(cuts: dict[int, tuple[int, Cuts]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile = np.zeros(batch.num_rows, np.int32)
            for dim, rows, x in by_length(batch.column(2), np.int64):
                first, own = cuts.get(dim, (0, None))
                tile[rows] = first + (own.tile(x) if own else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile)], [*batch.schema.names, "tile"])

    return run


def packed(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """The rows with their part of the upper level (at most about TILE_BYTES of vectors), their number and width."""
    spark = rows.sparkSession
    spread = store(rows)
    n, width = spread.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    limit = max(LEAF, min(TILE_BYTES // (8 * width), -(-n // (4 * spark.sparkContext.defaultParallelism))))
    n_tiles = min(-(-n // limit), SAMPLE_ROWS // PER_TILE)
    cuts: dict[int, tuple[int, Cuts]] = {}
    if n_tiles > 1:
        share = spread.filter(F.col("spread") < int((1 << 31) * min(1.0, SAMPLE_ROWS / n))).select("vector").toArrow()
        first = 1  # tile 0 has the lengths that the sample lacks
        for dim, chosen, x in by_length(share["vector"].combine_chunks(), np.int64):
            cuts[dim] = (first, Cuts(x, -(-n_tiles * len(chosen) // len(share))))
            first += cuts[dim][1].n
    placed = store(spread.mapInArrow(_place(cuts), PACKED_SCHEMA))
    parts, plan = 0, []
    for r in sorted(placed.groupBy("tile").count().collect()):
        split = -(-r["count"] // limit)
        plan.append((r["tile"], parts, split))
        parts += split
    plan = spark.createDataFrame(plan, "tile int, part_from long, split long")
    return placed.join(F.broadcast(plan), "tile").select(
        "id", "label", "vector", (F.col("part_from") + F.pmod("spread", "split")).alias("part")
    ), n, width


def _best(anchors: DataFrame, index: DataFrame, size: tuple[int, int], k: int, same: bool) -> DataFrame:
    """id, key, slot, found: the k best rows of each anchor in each of its windows."""
    n, width = size
    q_blocks, r_blocks = blocks(index.sparkSession, anchors.count(), n, width)
    cell_rows = dealt(
        anchors.withColumn("part", F.lit(0).cast("long")).withColumn("block", F.xxhash64("id", "key")),
        index.withColumn("block", F.col("part")), q_blocks, r_blocks, ("part",),
    )
    lists = cell_rows.mapInArrow(_search(k, same), FOUND_SCHEMA)
    return lists.groupBy("id", "key", "slot").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("found")
    )


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 3, window: tuple[int, int] = (50, 95),
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vector_col` holds whole numbers. The positives of an anchor are the `n_positives` best rows
    of its label, the negatives of a positive the best rows of other labels whose score
    is between `window[0]` and `window[1]` percent of the positive's.
    """
    names = (id_col, label_col, vector_col)
    index, *size = packed(usable(rows, *names))
    asked = store(
        usable(anchors, *names).drop("spread").withColumn("key", F.xxhash64("label", "vector")).dropDuplicates(["id", "key"])
    )
    everything = [F.array(F.lit(x).cast("long")) for x in ANY]
    positives = store(_best(
        asked.withColumns({"low": everything[0], "high": everything[1]}), index, size, n_positives, True
    ).drop("slot"))

    def percent(of, up: bool):
        """A share of a score as a whole number, rounded up or down."""
        x = of * (-window[0] if up else window[1])
        down = ((x - F.pmod(x, F.lit(100))) / 100).cast("long")
        return -down if up else down

    def padded(values, empty: int):
        return F.slice(F.concat(values, F.array_repeat(F.lit(empty).cast("long"), n_positives)), 1, n_positives)

    windows = positives.select(
        "id", "key", padded(F.transform("found", lambda f: percent(-f["worse"], True)), ANY[1]).alias("low"),
        padded(F.transform("found", lambda f: percent(-f["worse"], False)), ANY[0]).alias("high"),
    )
    negatives = _best(asked.join(windows, ["id", "key"]), index, size, n_negatives, False)
    pairs = positives.select("id", "key", F.posexplode("found").alias("slot", "positive"))
    return negatives.filter(F.size("found") > 0).join(pairs, ["id", "key", "slot"]).select(
        "id", "positive", F.posexplode("found").alias("place", "negative")
    ).select(
        F.col("id").alias("anchor_id"), F.col("positive.near").alias("positive_id"),
        (F.col("place") + 1).cast("int").alias("rank"), F.col("negative.near").alias("negative_id"),
        (-F.col("positive.worse")).alias("positive_score"), (-F.col("negative.worse")).alias("negative_score"),
    )
