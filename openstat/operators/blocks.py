"""Distance sums over all pairs of points, block by block.

Points are dealt into blocks of bounded size, a row per block; a task compares one block with
a strip of a few others and returns a sum per point and cluster. No point pair leaves a task, no
task holds more than its blocks, and a block is moved once per other block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from openstat.session import cut_lineage

#: most rows of a block, most bytes of it, and blocks that a task compares with one block
BLOCK_ROWS, BLOCK_BYTES, STRIP = 16_384, 4 << 20, 4
#: squared distances below this share of the squared norms are worked out again by differences
_CANCELS = 1e-5


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between two blocks, one dimension at a time."""
    total = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        gap = a[:, d][:, None] - b[:, d][None, :]
        total += gap * gap
    return np.sqrt(total)


def _member(codes: np.ndarray, width: int) -> np.ndarray:
    """Points by clusters: 1 where a point belongs; a code below 0 belongs nowhere."""
    member = np.zeros((len(codes), width))
    for column in codes.T:
        at = np.flatnonzero(column >= 0)
        member[at, column[at]] = 1.0
    return member


def _plain_sums(a: np.ndarray, b: np.ndarray, codes: np.ndarray, width: int) -> np.ndarray:
    """Sums by differences, for points that are not finite."""
    out = np.zeros((len(a), width))
    for at in range(0, len(a), 256):
        for there in range(0, len(b), 4096):
            d = distances(a[at : at + 256], b[there : there + 4096])
            for column in codes[there : there + 4096].T:
                for c in np.unique(column[column >= 0]):
                    out[at : at + 256, c] += d[:, column == c].sum(axis=1)
    return out


def distance_sums(a: np.ndarray, b: np.ndarray, codes: np.ndarray, width: int) -> np.ndarray:
    """Per point of `a`, the sum of its distances to the points of `b` in each cluster.

    Distances come from a matrix product; those that it would blur, of points very near to each
    other for their norms, are worked out by differences. Both sides go in order of their
    norms, so a far point does not make others look near.
    """
    sums = np.zeros((len(a), width))
    fine_a, fine_b = np.isfinite(a).all(axis=1), np.isfinite(b).all(axis=1)
    if not (fine_a.all() and fine_b.all()):
        sums[~fine_a] = _plain_sums(a[~fine_a], b, codes, width)
        sums[fine_a] = _plain_sums(a[fine_a], b[~fine_b], codes[~fine_b], width)
        if fine_a.any() and fine_b.any():
            sums[fine_a] += distance_sums(a[fine_a], b[fine_b], codes[fine_b], width)
        return sums
    if not len(a) or not len(b):
        return sums
    middle = np.median(b, axis=0)
    norm_a, norm_b = ((a - middle) ** 2).sum(axis=1), ((b - middle) ** 2).sum(axis=1)
    by_a, by_b = np.argsort(norm_a, kind="stable"), np.argsort(norm_b, kind="stable")
    a, b, norm_a, norm_b = a[by_a], b[by_b], norm_a[by_a], norm_b[by_b]
    member = _member(codes[by_b], width)
    left = np.column_stack([-2.0 * (a - middle), norm_a, np.ones(len(a))])
    right = np.column_stack([b - middle, np.ones(len(b)), norm_b]).T.copy()
    room = np.empty(128 * 512)  # one matrix of distances that stays in the cache
    for at in range(0, len(a), 128):
        some, total = a[at : at + 128], np.zeros((len(a[at : at + 128]), width))
        for there in range(0, len(b), 512):
            others = b[there : there + 512]
            flat = room[: len(some) * len(others)]
            d = np.matmul(left[at : at + 128], right[:, there : there + 512], out=flat.reshape(len(some), len(others)))
            near = np.flatnonzero(flat <= _CANCELS * (norm_a[at : at + 128][-1] + norm_b[there : there + 512][-1]))
            if len(near) * 8 > d.size:
                d = distances(some, others)
            else:
                i, j = np.divmod(near, len(others))
                flat[near] = ((some[i] - others[j]) ** 2).sum(axis=1)
                np.sqrt(d, out=d)
            total += d @ member[there : there + 512]
        sums[by_a[at : at + 128]] = total
    return sums


def label_sums(points: DataFrame, n_rows: int, dims: int, width: int) -> DataFrame:
    """(row_id, s0, s1, ...): sums of a point's distances to the points of each cluster.

    `points` holds row_id, x (an array of `dims` doubles) and codes (per labeling the number of
    the point's cluster, below `width`, or -1).
    """
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dims), max(1_000, n_rows // 16)))
    blocks = max(1, -(-n_rows // rows))
    strips = -(-blocks // STRIP)

    def pack(table: pa.Table) -> pa.Table:
        ids = table["row_id"].combine_chunks()
        x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("float64")
        codes = table["codes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("int32")
        held = [
            table["block"][:1].combine_chunks(), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            pa.array([x.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary()),
        ]
        return pa.table(held, names=["block", "ids", "x", "codes"])

    packed = cut_lineage(
        points.withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int"))
        .groupBy("block").applyInArrow(pack, "block int, ids array<bigint>, x binary, codes binary")
    )  # a row per block
    one = packed.select(
        F.col("block").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"), "ids", "x"
    )
    others = packed.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("a"),
        F.floor(F.col("block") / STRIP).cast("int").alias("strip"), "x", "codes",
    )
    names = [f"s{i}" for i in range(width)]

    def run(mine: pa.Table, strip: pa.Table) -> pa.Table:
        ids, sums = pa.array([], pa.int64()), np.zeros((0, width))
        if mine.num_rows and strip.num_rows:
            ids = mine["ids"].combine_chunks().flatten()
            a = np.frombuffer(mine["x"][0].as_py(), "float64").reshape(-1, dims)
            sums = np.zeros((len(a), width))
            for x, codes in zip(strip["x"], strip["codes"]):
                b = np.frombuffer(x.as_py(), "float64").reshape(-1, dims)
                sums += distance_sums(a, b, np.frombuffer(codes.as_py(), "int32").reshape(len(b), -1), width)
        return pa.table([ids, *[pa.array(sums[:, i].copy()) for i in range(width)]], names=["row_id", *names])

    tasks = min(blocks * strips, 4_096)
    one, others = (side.repartition(tasks, "a", "strip") for side in (one, others))
    schema = "row_id long, " + ", ".join(f"{n} double" for n in names)
    return one.groupBy("a", "strip").cogroup(others.groupBy("a", "strip")).applyInArrow(run, schema)
