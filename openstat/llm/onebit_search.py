"""Nearest neighbours by inner product, over randomly rotated one-bit codes.

Index: each row, less the mean of all rows, is scaled to length one, rotated by a random
orthogonal transform (three rounds of random signs and a Hadamard transform, into at
least `bits` dimensions per component) and kept as the signs of its coordinates, packed,
with two scalars: the length of the residual, and the inner product of the rotated
vector with its code, which corrects the estimate. The index is written once.

Search: a query is rotated too; its inner product with the signs of a code, divided by
the correction, is an unbiased estimate, whose error is bounded by `confidence` standard
deviations of the random rotation. Rows whose upper bound lies below
the k-th best score found so far are left out; all others are scored on the original
vectors in double precision, component by component in order, so that equal vectors have
equal scores. No row is left out for any other reason; `confidence` sets the recall.

Blocks of queries meet blocks of rows; a task holds one block of queries (a bounded
number of bytes) and streams through the rows, and gives k rows per query. Ranks are
merged per query from one short list per block.

Rows without id, and vectors that are null, empty, zero or hold null or non-finite components,
take no part. Vectors are compared with those of their own length. A query does not find
rows of its own id. A query row that repeats with the same vector counts once; with
another vector it is a query of its own. Fewer rows than k: all. Empty input: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from openstat.llm.vectors import TopK, blocks, by_length, cells, dealt, finite
from openstat.session import store

#: Numbers in a tile of estimates or scores; rows per wanted neighbour scored first; share of a float's rounding.
TILE, SEEDS, ROUNDING = 1 << 21, 3, 1e-5
CODE_SCHEMA = "vec_id long, vector array<double>, code binary, length double, fit double, block long"
CODES = pa.schema([
    ("vec_id", pa.int64()), ("vector", pa.list_(pa.float64())), ("code", pa.binary()),
    ("length", pa.float64()), ("fit", pa.float64()), ("block", pa.int64()),
])
FOUND_SCHEMA = "vec_id long, query_key long, found array<struct<worse:double,near:long>>"


def code_bits(dim: int, bits: int) -> int:
    """Coordinates after the rotation: a power of two, at least 64 and `bits` per component."""
    return max(64, 1 << (bits * dim - 1).bit_length())


def rotated(x: np.ndarray, width: int) -> np.ndarray:
    """Rows in `width` dimensions, turned by the random orthogonal transform of that width."""
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng(width).choice((-1.0, 1.0), (3, width))
    for s in signs:
        out *= s
        h = 1
        while h < width:
            pairs = out.reshape(len(x), -1, 2, h)
            out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(x), width)
            h *= 2
        out /= np.sqrt(width)
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, rows, x in by_length(batch.column(0), float):
            sums[dim] = sums.get(dim, 0) + np.r_[np.count_nonzero(x.any(1)), x.sum(0)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], ["dim", "sums"]
    )


def centers(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean of the vectors of each length: as many numbers as the lengths add up to."""
    parts = vectors.select("vector").mapInArrow(_sums, "dim int, sums array<double>")
    total = parts.select("dim", F.posexplode("sums")).groupBy("dim", "pos").agg(F.sum("col").alias("s")).collect()
    out: dict[int, np.ndarray] = {}
    for r in sorted(total, key=lambda r: (r["dim"], r["pos"])):
        out[r["dim"]] = np.r_[out.get(r["dim"], np.empty(0)), r["s"]]
    return {dim: s[1:] / max(s[0], 1) for dim, s in out.items()}


def _encode(middle: dict[int, np.ndarray], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, x in by_length(batch.column(1), float):
                rows, x = rows[sound := x.any(1)], x[sound]
                if not len(rows):
                    continue
                width = code_bits(dim, bits)
                with np.errstate(all="ignore"):
                    rest = x - middle[dim]
                    length = np.sqrt((rest * rest).sum(1))
                    turned = rotated(rest / np.where(length > 0, length, 1)[:, None], width)
                    fit = np.where(length > 0, np.abs(turned).sum(1) / np.sqrt(width), 1.0)
                packed = np.packbits(turned >= 0, axis=1)
                ids = batch.column(0).take(pa.array(rows))
                spread = np.random.default_rng([dim, len(rows), int(ids[0].as_py()) & 0xFFFFFFFF]).integers(0, 1 << 31, len(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dim), pa.array(x.ravel())),
                        pa.array([row.tobytes() for row in packed], pa.binary()), pa.array(length), pa.array(fit), pa.array(spread),
                    ],
                    schema=CODES,
                )

    return run


class Queries:
    """The queries of one block and one vector length, with the k best rows that each has found."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, x: np.ndarray, middle: np.ndarray, bits: int, confidence: float, k: int) -> None:
        self.ids, self.keys, self.x = ids, keys, x
        width = code_bits(x.shape[1], bits)
        self.norm, self.base = np.sqrt((x * x).sum(1)), x @ middle
        self.turned = (rotated(x, width) / np.sqrt(width)).astype(np.float32)
        self.spread = confidence / np.sqrt(width - 1)
        self.top = TopK(len(ids), k)

    def meet(self, ids: np.ndarray, x: np.ndarray, code: np.ndarray, length: np.ndarray, fit: np.ndarray) -> None:
        """Compare all queries with a batch of rows, a tile of queries at a time."""
        signs = np.unpackbits(code, axis=1).astype(np.float32)
        signs *= 2
        signs -= 1
        unit = length / fit
        wobble = (length * np.sqrt(np.maximum(1 - fit * fit, 0)) / fit * self.spread + ROUNDING * unit).astype(np.float32)
        tile = max(1, TILE // len(ids))
        for a in range(0, len(self.ids), tile):
            guess = self.turned[a : a + tile] @ signs.T
            guess *= unit.astype(np.float32)
            base, norm = self.base[a : a + tile, None], self.norm[a : a + tile, None].astype(np.float32)
            guess += base.astype(np.float32)
            lacking = np.flatnonzero(self.top.n[a : a + tile] < self.top.k)
            seeds = SEEDS * self.top.k
            if len(lacking) and seeds < len(ids):
                first = np.argpartition(-guess[lacking], seeds, axis=1)[:, :seeds]
                self.score(np.repeat(lacking + a, seeds), first.ravel(), ids, x)
            guess += norm * wobble
            guess += np.abs(base).astype(np.float32) * ROUNDING
            least = self.top.least[a : a + tile, None].astype(np.float32)
            opened = ~(guess < np.nextafter(least, -np.inf, dtype=np.float32))
            if len(lacking) and seeds < len(ids):
                opened[lacking[:, None], first] = False
            query, row = np.nonzero(opened)
            self.score(query + a, row, ids, x)

    def score(self, query: np.ndarray, row: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Inner products in double precision, added up in the order of the components."""
        other = self.ids[query] != ids[row]
        query, row = query[other], row[other]
        step = max(1, TILE // x.shape[1])
        for a in range(0, len(query), step):
            q, r = query[a : a + step], row[a : a + step]
            scores = np.cumsum(x[r] * self.x[q], axis=1)[:, -1]
            scores[np.isnan(scores)] = -np.inf
            good = scores >= self.top.least[q]
            self.top.add(q[good], scores[good], ids[r[good]])

    def best(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids), pa.array(self.keys), self.top.lists()], ["vec_id", "query_key", "found"])


def _search(middle: dict[int, np.ndarray], bits: int, confidence: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, block = None, [], {}

        def ready() -> None:
            if waiting:
                joined = pa.Table.from_batches(waiting).combine_chunks()
                ids, keys = joined["vec_id"].to_numpy(), joined["query_key"].to_numpy()
                for dim, rows, x in by_length(joined["vector"].combine_chunks(), float):
                    rows, x = rows[sound := x.any(1)], x[sound]
                    if len(rows):
                        block[dim] = Queries(ids[rows], keys[rows], x, middle[dim], bits, confidence, k)
                waiting.clear()

        with np.errstate(all="ignore"):
            for (cell, is_row), part in cells(batches, "cell", "is_row"):
                if cell != at:
                    yield from (b.best() for b in block.values())
                    at, block = cell, {}
                    waiting.clear()
                if not is_row:
                    waiting.append(part)
                    continue
                ready()
                get = lambda name: part.column(part.schema.get_field_index(name))  # noqa: B023, E731
                ids, length, fit = (get(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "length", "fit"))
                for dim, rows, x in by_length(get("vector"), float):
                    if dim in block:
                        code = b"".join(get("code").take(pa.array(rows)).to_pylist())
                        bytes_of = np.frombuffer(code, np.uint8).reshape(len(rows), -1)
                        block[dim].meet(ids[rows], x, bytes_of, length[rows], fit[rows])
            yield from (b.best() for b in block.values())

    return run


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    bits: int = 4, confidence: float = 4.0,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k rows nearest to each query."""

    def usable(df: DataFrame) -> DataFrame:
        sound = df.filter(F.col(id_col).isNotNull() & finite(F.col(vector_col)))
        return sound.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))

    spark = rows.sparkSession
    taking_part = usable(rows)
    asked = usable(queries).withColumn("query_key", F.xxhash64("vector")).dropDuplicates(["vec_id", "query_key"])
    middle = centers(taking_part.unionByName(usable(queries)))
    index = store(taking_part.mapInArrow(_encode(middle, bits), CODE_SCHEMA))
    q_blocks, r_blocks = blocks(spark, asked.count(), index.count(), max((code_bits(d, bits) for d in middle), default=64))
    cell_rows = dealt(asked.withColumn("block", F.xxhash64("vec_id", "query_key")), index, q_blocks, r_blocks)
    lists = cell_rows.mapInArrow(_search(middle, bits, confidence, k), FOUND_SCHEMA)
    best = lists.groupBy("vec_id", "query_key").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("found")
    )
    return best.select(F.col("vec_id").alias("query_id"), F.posexplode("found")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.near").alias("vec_id"),
        (-F.col("col.worse")).alias("score"),
    )
