"""What the two vector searches share: usable vectors, and query blocks dealt against row blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of a block of queries, and rows of a block of candidates that one task streams through.
BLOCK_BYTES, QUERY_ROWS, BLOCK_ROWS, LEAST_ROWS = 16 << 20, 4096, 1 << 20, 1024


def finite(vector: Column) -> Column:
    """True for a vector that is not null and holds no null or non-finite component (NaN counts as larger than all)."""
    return F.coalesce(F.forall(vector, lambda x: F.abs(x) < float("inf")), F.lit(False))


def matrix(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end, and the length of each list."""
    sizes = np.asarray(pa.compute.list_value_length(column).fill_null(0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False), sizes


def by_length(column: pa.Array, dtype: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of a list column: the length, the rows that have it, and their lists as a matrix."""
    values, sizes = matrix(column, dtype)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        if len(rows) == len(sizes):
            yield int(size), rows, values.reshape(len(rows), int(size))
        else:
            yield int(size), rows, values[starts[rows][:, None] + np.arange(size)]


def blocks(spark: SparkSession, n_queries: int, n_rows: int, width: int) -> tuple[int, int]:
    """Numbers of query blocks and of row blocks.

    A block of queries fits in BLOCK_BYTES, so that a task can hold it; rows stream, and
    are cut only as far as the cluster has tasks to fill or a block exceeds BLOCK_ROWS.
    """
    held = max(64, min(QUERY_ROWS, BLOCK_BYTES // (8 * max(width, 1))))
    q = max(1, -(-n_queries // held))
    fill = min(-(-2 * spark.sparkContext.defaultParallelism // q), -(-n_rows // LEAST_ROWS))
    return q, max(1, fill, -(-n_rows // BLOCK_ROWS))


def dealt(queries: DataFrame, rows: DataFrame, q_blocks: int, r_blocks: int, order: tuple[str, ...] = ()) -> DataFrame:
    """Every block of queries beside every block of rows: queries first (`is_row` false), then the rows.

    Both have the columns `block` (any whole number, spread evenly) and those of the other.
    """
    q = queries.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1)))).withColumn(
        "cell", F.pmod("block", F.lit(q_blocks)) * r_blocks + F.col("_other")
    )
    r = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).withColumn(
        "cell", F.col("_other") * r_blocks + F.pmod("block", F.lit(r_blocks))
    )
    both = q.withColumn("is_row", F.lit(False)).unionByName(r.withColumn("is_row", F.lit(True)), allowMissingColumns=True)
    return both.drop("_other", "block").repartitionById(q_blocks * r_blocks, F.col("cell").cast("int")).sortWithinPartitions("cell", "is_row", *order)


def cells(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of the batches with equal values of `keys`, in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        for x in columns:
            change[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield tuple(x[a] for x in columns), batch.slice(a, b - a)


class TopK:
    """The k best (score, id) of each of n askers: higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int, dtype: type = float) -> None:
        self.low = -np.inf if dtype is float else np.iinfo(dtype).min
        self.scores = np.full((n, k), self.low, dtype)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.n, self.k = np.zeros(n, np.int64), k

    @property
    def least(self) -> np.ndarray:
        """The k-th best score of each asker, or the lowest value while there are fewer."""
        return self.scores[:, -1]

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(rows):
            return
        self.n = np.minimum(self.n + np.bincount(rows, minlength=len(self.n)), self.k)
        touched = np.flatnonzero(np.bincount(rows, minlength=len(self.n)))
        r = np.r_[rows, np.repeat(touched, self.k)]
        s = np.r_[scores, self.scores[touched].ravel()]
        i = np.r_[ids, self.ids[touched].ravel()]
        order = np.lexsort((i, ~s if s.dtype.kind == "i" else -s, r))
        r, s, i = r[order], s[order], i[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        best = place < self.k
        self.scores[r[best], place[best]] = s[best]
        self.ids[r[best], place[best]] = i[best]

    def lists(self) -> pa.Array:
        """For each asker a list of (worse: the negated score, near: the id), best first."""
        kept = np.arange(self.k) < self.n[:, None]
        found = pa.StructArray.from_arrays([pa.array(-self.scores[kept]), pa.array(self.ids[kept])], ["worse", "near"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(self.n)].astype(np.int32)), found)
