"""Exact neighbours in space cells.

Points go to cells of a k-d tree: split at the median of the widest dimension, fitted
on a bounded number of sampled points per cell, so cells follow the density and a
crowded region has many of them. Each cell's bounding box is taken over all its points.
A query visits the cells whose boxes lie within its radius and no others; a task
holds the points of one cell in leaves of LEAF rows with boxes of their own, and
streams its visitors through them, nearest leaves first. No table of point pairs leaves a task.

Points should be distinct: equal points would sit in one cell however often it is split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from openstat.session import store

#: Most points planned for a cell, fewest if there are tasks to fill, sampled points for each cell.
CELL_ROWS, LEAST_ROWS, SAMPLED = 16_384, 512, 32
#: Rows of a leaf, and visitors that pass through the leaves together.
LEAF = 256
#: Visitors of a cell above which its points are copied for another task.
VISITORS = 262_144


def split(x: np.ndarray, pages: int) -> list[np.ndarray]:
    """Rows of x in about `pages` parts, by halving at the middle of the widest dimension."""
    parts, todo = [], [(np.arange(len(x)), pages)]
    while todo:
        rows, n = todo.pop()
        if n <= 1 or len(rows) <= 1:
            parts.append(rows)
            continue
        own = x[rows]
        rows = rows[np.argsort(own[:, np.ptp(own, axis=0).argmax()], kind="stable")]
        half = len(rows) // 2
        todo += [(rows[:half], n - n // 2), (rows[half:], n // 2)]
    return parts


class Cuts:
    """The splits of a k-d tree as arrays; leaves are numbered cells."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.nodes: list[tuple[int, float, int, int]] = []
        self.n = 0
        self.root = self._grow(sample, cells)

    def _grow(self, x: np.ndarray, cells: int) -> int:
        """Index of a split, or -1 - cell."""
        spread = np.ptp(x, axis=0) if len(x) > 1 else np.zeros(1)
        if cells <= 1 or spread.max() == 0:
            self.n += 1
            return -self.n
        dim = int(spread.argmax())
        cut = float(np.median(x[:, dim]))
        below = x[:, dim] <= cut
        if below.all():
            below = x[:, dim] < cut
            cut = float(x[below, dim].max())
        at = len(self.nodes)
        self.nodes.append((dim, cut, 0, 0))
        self.nodes[at] = (dim, cut, self._grow(x[below], cells - cells // 2), self._grow(x[~below], cells // 2))
        return at

    def cell(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.empty(len(x), np.int32), [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            dim, cut, low, high = self.nodes[node]
            below = x[rows, dim] <= cut
            todo += [(low, rows[below]), (high, rows[~below])]
        return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class Space:
    """Points by cell (columns of the points and `cell`), and the box of each cell."""

    points: DataFrame
    low: np.ndarray
    high: np.ndarray

    @property
    def width(self) -> int:
        return self.low.shape[1]


def in_cells(points: DataFrame, width: int) -> Space:
    """Points (row_id, x of `width` numbers, and other columns) in the cells of a k-d tree."""
    points = store(points)
    n = points.count()
    fill = -(-n // (2 * points.sparkSession.sparkContext.defaultParallelism))
    cells = max(1, -(-n // max(LEAST_ROWS, min(CELL_ROWS, fill))))
    share = min(1.0, SAMPLED * cells / max(n, 1))
    picked = points.where(F.xxhash64("row_id").bitwiseAND(F.lit((1 << 62) - 1)) <= int(share * (1 << 62)))
    sample = matrix(picked.select("x").toArrow()["x"].combine_chunks(), width)
    cuts = Cuts(sample, cells)
    schema = T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType())])
    at = points.columns.index("x")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = pa.array(cuts.cell(matrix(batch.column(at), width)))
            yield pa.RecordBatch.from_arrays([*batch.columns, cell], [*batch.schema.names, "cell"])

    placed = store(points.mapInArrow(place, schema))
    ends = [f(F.col("x")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(width)]
    low, high = np.full((cuts.n, width), np.inf), np.full((cuts.n, width), -np.inf)
    for r in placed.groupBy("cell").agg(*ends).collect():  # a row per cell
        low[r["cell"]], high[r["cell"]] = r[1 : 1 + width], r[1 + width :]
    return Space(placed, low, high)


def _gap(low: np.ndarray, high: np.ndarray, x: np.ndarray, top: np.ndarray | None = None) -> np.ndarray:
    """Squared distance from each point (or box x..top) to each box, no larger than the true one."""
    top = x if top is None else top
    total = np.zeros((len(x), len(low)))
    for d in range(x.shape[1]):
        gap = np.maximum(low[None, :, d] - top[:, None, d], x[:, None, d] - high[None, :, d])
        total += np.square(np.maximum(gap, 0))
    return total * (1 - 1e-12)


class Leaves:
    """The points of a cell, by leaf."""

    def __init__(self, x: np.ndarray) -> None:
        parts = split(x, -(-len(x) // LEAF))
        self.rows = parts
        self.x = [x[p] for p in parts]
        self.low, self.high = np.stack([v.min(0) for v in self.x]), np.stack([v.max(0) for v in self.x])

    def pairs(self, x: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Visitor, point and distance of all pairs within the visitor's radius, some at a time.

        The caller may lower `radius` between two steps; a negative one ends a visitor's search.
        """
        for own in split(x, -(-len(x) // LEAF)):
            if not len(own):
                continue
            tile = x[own]
            gap = _gap(self.low, self.high, tile.min(0)[None], tile.max(0)[None])[0]
            for leaf in np.argsort(gap, kind="stable"):
                most = radius[own].max()
                if most < 0 or gap[leaf] > most * most:
                    break
                d = np.zeros((len(own), len(self.rows[leaf])))
                for k in range(x.shape[1]):
                    d += np.square(tile[:, k][:, None] - self.x[leaf][:, k][None, :])
                np.sqrt(d, out=d)
                i, j = np.nonzero(d <= radius[own][:, None])
                if len(i):
                    yield own[i], self.rows[leaf][j], d[i, j]


Task = Callable[[Leaves, pa.Table, np.ndarray, pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]]


def meet(queries: DataFrame, space: Space, task: Task, schema: str, elsewhere: bool = True) -> DataFrame:
    """Run `task(leaves, points, visitors' x, visitors, radius)` for the visitors of every cell.

    Queries have row_id, x, r and `cell`; a query visits every cell within r, its own
    too. With `elsewhere` false it visits its own alone; with r above zero and a `home` column true, all but its own.
    """
    width, low, high = space.width, space.low, space.high
    if elsewhere:
        at, radius, own = (queries.columns.index(c) for c in ("x", "r", "cell"))
        skip = queries.columns.index("home") if "home" in queries.columns else None

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                step = max(1, (1 << 20) // len(low))
                for a in range(0, whole.num_rows, step):
                    batch = whole.slice(a, step)
                    x, r = matrix(batch.column(at), width), batch.column(radius).to_numpy(zero_copy_only=False)
                    hit = _gap(low, high, x) <= (r * r)[:, None]
                    if skip is not None:
                        hit[np.arange(len(x)), batch.column(own).to_numpy(zero_copy_only=False)] = False
                    i, j = np.nonzero(hit)
                    part = batch.take(pa.array(i))
                    columns = [c if n != own else pa.array(j.astype(np.int32)) for n, c in enumerate(part.columns)]
                    yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        queries = store(queries.mapInArrow(reach, queries.schema))
    spark = queries.sparkSession
    tasks, plan = 0, []
    for r in queries.groupBy("cell").count().collect():  # a row per cell
        copies = -(-r["count"] // VISITORS)
        plan.append((r["cell"], tasks, tasks + copies - 1))
        tasks += copies
    plan = F.broadcast(spark.createDataFrame(plan, "cell int, first int, last int"))
    one = F.col("first") + F.pmod(F.xxhash64("row_id"), F.col("last") - F.col("first") + 1).cast("int")
    visitors = queries.join(plan, "cell").withColumns({"task": one, "visits": F.lit(True)}).drop("cell", "first", "last", "home")
    points = space.points.join(plan, "cell").withColumns(
        {"task": F.explode(F.sequence("first", "last")), "visits": F.lit(False)}
    ).drop("cell", "first", "last")
    both = points.unionByName(visitors, allowMissingColumns=True).repartitionById(max(tasks, 1), F.col("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, leaves, points = None, [], None, None
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            task_id, visits = (get(c).to_numpy(zero_copy_only=False) for c in ("task", "visits"))
            change = (task_id[1:] != task_id[:-1]) | (visits[1:] != visits[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if task_id[a] != now:
                    now, held, leaves = task_id[a], [], None
                if not visits[a]:
                    held.append(part)
                    continue
                if leaves is None:
                    if not held:
                        continue
                    points = pa.Table.from_batches(held).combine_chunks()
                    leaves = Leaves(matrix(points["x"].combine_chunks(), width))
                x = matrix(part.column(part.schema.get_field_index("x")), width)
                radius = np.array(part.column(part.schema.get_field_index("r")).to_numpy(zero_copy_only=False))
                yield from task(leaves, points, x, part, radius)

    return both.sortWithinPartitions("task", "visits").mapInArrow(run, schema)


def distinct_points(points: DataFrame, keep: int = 1) -> DataFrame:
    """row_id, x, loc, n: of equal points (no matter how many) the `keep` smallest ids.

    `loc` is the smallest id at the place, n the number of points there on the row of that id. Each
    batch is reduced before anything is shuffled, so a place that holds most points is no burden.
    """

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column, n = batch.columns
            if not len(ids):
                continue
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) + 0.0
            place = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1].ravel()
            ids, n = ids.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False)
            order = np.lexsort((ids, place))
            rank = np.arange(len(order)) - np.searchsorted(place[order], place[order])
            total = np.bincount(place, weights=n).astype(np.int64)
            good = order[rank < keep]
            first = rank[rank < keep] == 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[good]), column.take(pa.array(good)), pa.array(np.where(first, total[place[good]], 0))],
                ["row_id", "x", "n"],
            )

    rows = points.select("row_id", "x", F.lit(1).cast("long").alias("n")).mapInArrow(trim, "row_id long, x array<double>, n long")
    lists = rows.groupBy("x").agg(
        F.slice(F.sort_array(F.collect_list("row_id")), 1, keep).alias("ids"), F.sum("n").alias("n")
    )
    return lists.select(F.explode("ids").alias("row_id"), "x", F.col("ids")[0].alias("loc"), "n")
