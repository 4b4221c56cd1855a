"""Isolation forest and local outlier factor."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from openstat.operators.clusters import _array, _matrix
from openstat.operators.ranks import quantiles
from openstat.operators.sampling import sample_rows
from openstat.operators.space import distinct_points, in_cells, meet
from openstat.session import store

NODE = "tree int, node int, feature int, threshold double, low int, high int, size int, depth int"


def _average_path(n) -> np.ndarray:
    """Expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype="float64")
    safe = np.maximum(n, 2.0)
    length = 2.0 * (np.log(safe - 1.0) + 0.5772156649015329) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, length, np.where(n == 2, 1.0, 0.0))


def _grow(tree: int, x: np.ndarray, seed: int) -> pd.DataFrame:
    """Random splits down to single points or the depth limit."""
    rng = np.random.default_rng(seed * 1_000_003 + tree)
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes, stack = [], [(0, np.arange(len(x)), 0)]
    next_id = 1
    while stack:
        node, rows, depth = stack.pop()
        spread = np.ptp(x[rows], axis=0) if len(rows) > 1 else np.zeros(x.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(usable) == 0:
            nodes.append((tree, node, -1, 0.0, -1, -1, len(rows), depth))
            continue
        feature = int(rng.choice(usable))
        values = x[rows, feature]
        cut = float(rng.uniform(values.min(), values.max()))
        below = values <= cut
        low, high = next_id, next_id + 1
        next_id += 2
        nodes.append((tree, node, feature, cut, low, high, len(rows), depth))
        stack += [(low, rows[below], depth + 1), (high, rows[~below], depth + 1)]
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODE.split(", ")])


def train_forest(points: DataFrame, columns: list[str], trees: int = 100, rows_per_tree: int = 256,
                 seed: int = 42) -> DataFrame:
    """Node table of the forest, at most trees x 511 rows.

    A bounded pool is drawn by hash; each row joins a tree when its hash for that
    tree is low, and every tree keeps its `rows_per_tree` lowest.
    """
    pool = sample_rows(points.select("row_id", _array(columns).alias("x")), trees * rows_per_tree, seed, ["row_id"])
    size = pool.count()
    share = min(1.0, (rows_per_tree + 6 * math.sqrt(rows_per_tree) + 20) / max(size, 1))
    bound = int(share * 2**62)
    chosen = pool.select(
        "x", "row_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    ).withColumn("h", F.xxhash64("row_id", "tree", F.lit(seed)).bitwiseAND(F.lit(2**62 - 1))).where(F.col("h") <= bound)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["h", "row_id"]).head(rows_per_tree)
        return _grow(int(rows["tree"].iloc[0]), _matrix(rows), seed)

    return chosen.groupBy("tree").applyInPandas(build, NODE)


def _levels(tree: pd.DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """A tree with all leaves at one depth: features and cuts per level, path lengths of the leaves.

    What lies below a leaf has the leaf's length, whichever way a row goes there.
    """
    feature, cut, low, high = (tree[c].to_numpy() for c in ("feature", "threshold", "low", "high"))
    length = tree["depth"].to_numpy() + _average_path(tree["size"].to_numpy())
    at, levels = np.zeros(1, "int64"), []
    while (feature[at] >= 0).any():
        inner = feature[at] >= 0
        levels.append((np.where(inner, feature[at], 0), np.where(inner, cut[at], np.inf)))
        at = np.column_stack([np.where(inner, low[at], at), np.where(inner, high[at], at)]).ravel()
    return levels, length[at]


def _path_total(x: np.ndarray, trees: list) -> np.ndarray:
    """Sum of the path lengths of each row over all trees; a value that is not at most the cut goes high."""
    n, values = len(x), np.ascontiguousarray(x.T).ravel()
    rows, total = np.arange(n), np.zeros(n)
    for levels, length in trees:
        at = np.zeros(n, "int64")
        for feature, cut in levels:
            low = values.take((feature * n).take(at) + rows) <= cut.take(at)
            at += at
            at += ~low
        total += length.take(at)
    return total


def isolation_scores(points: DataFrame, columns: list[str], forest: DataFrame, rows_per_tree: int = 256,
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, score, kept columns): lower is more unusual, -1 to 0. The forest is a few thousand bounded rows."""
    nodes = forest.toPandas()
    shared = points.sparkSession.sparkContext.broadcast(
        [_levels(t.sort_values("node").reset_index(drop=True)) for _, t in nodes.groupby("tree")]
    )
    norm = float(_average_path(int(nodes[nodes["node"] == 0]["size"].max())))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns[1 : 1 + width]])
            total = np.concatenate([_path_total(x[at : at + 8_192], trees) for at in range(0, max(len(x), 1), 8_192)])
            scores = pa.array(-(2.0 ** (-(total / len(trees)) / norm)))
            yield pa.RecordBatch.from_arrays([batch.column(0), scores, *batch.columns[1 + width :]], ["row_id", "score", *keep])

    width, held = len(columns), points.schema
    values = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    schema = T.StructType([held["row_id"], T.StructField("score", T.DoubleType()), *[held[c] for c in keep]])
    return points.select("row_id", *values, *keep).mapInArrow(score, schema)


def flag_lowest(scored: DataFrame, share: float = 0.02) -> DataFrame:
    """Rows strictly below the exact `share` quantile of the score."""
    cut = quantiles(scored, "score", {"cut": share})
    return scored.withColumn("unusual", F.col("score") < cut.scalar())


def neighbor_count(n_rows: int) -> int:
    return min(35, max(5, n_rows // 20))


def _nearest(k: int):
    """The k nearest points of each visitor within its radius, equal distances by id."""

    def run(leaves, points, x, visitors, radius) -> Iterator[pa.RecordBatch]:
        ids, places = points["row_id"].to_numpy(), points["loc"].to_numpy()
        who = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for visitor, point, d in leaves.pairs(x, radius):
            touched = np.zeros(len(x), bool)
            touched[visitor] = True
            old = touched[who[0]]
            i, j, e = (np.r_[a[old], b] for a, b in zip(who, (visitor, point, d)))
            order = np.lexsort((ids[j], e, i))
            i, j, e = i[order], j[order], e[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            last = rank == k - 1
            radius[i[last]] = e[last]
            best = rank < k
            who = tuple(np.r_[a[~old], b[best]] for a, b in zip(who, (i, j, e)))
        row_id = visitors.column(visitors.schema.get_field_index("row_id")).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row_id[who[0]]), pa.array(ids[who[1]]), pa.array(places[who[1]]), pa.array(who[2])],
            ["row_id", "other", "place", "d"],
        )

    return run


def nearest_places(points: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(row_id, other, place, d): for each distinct place its k nearest points, itself included.

    A place goes by the smallest id there. The k-th distance within a place's own cell
    bounds its search elsewhere, so two rounds are exact however the points lie.
    """
    kept = distinct_points(points.select("row_id", _array(columns).alias("x")), k)
    space = in_cells(kept.select("row_id", "x", "loc"), len(columns))
    askers = space.points.where("row_id = loc")
    schema = "row_id long, other long, place long, d double"
    home = store(meet(askers.select("row_id", "x", "cell", F.lit(float("inf")).alias("r")), space, _nearest(k), schema, elsewhere=False))
    reach = home.groupBy("row_id").agg(
        F.when(F.count(F.lit(1)) == k, F.max("d")).otherwise(float("inf")).alias("r")
    )
    travellers = askers.join(reach, "row_id").select("row_id", "x", "cell", "r", F.lit(True).alias("home"))
    found = home.unionByName(meet(travellers, space, _nearest(k), schema))
    nearest = W.partitionBy("row_id").orderBy("d", "other")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).drop("rank")


def local_outlier_factor(points: DataFrame, columns: list[str], n_rows: int, k: int | None = None) -> DataFrame:
    """(row_id, score): negative local outlier factor over exactly k neighbours, lower is more unusual.

    Points at one place have one score: each has the k + 1 nearest points of the place but for
    itself, and what it leaves out is worth the same as any other point of the place.
    """
    k = k or neighbor_count(n_rows)
    near = nearest_places(points, columns, k + 1)
    own = W.partitionBy("row_id")
    first = W.partitionBy("row_id").orderBy((F.col("place") != F.col("row_id")).cast("int"), "d", "other")
    near = store(near.withColumn("reach", F.max("d").over(own)).withColumn("self", F.row_number().over(first) == 1))
    reach = near.where("self").select(F.col("row_id").alias("place"), F.col("reach").alias("k_distance"))
    others = near.where("not self")
    density = store(
        others.join(reach, "place").groupBy("row_id")
        .agg((1.0 / (F.avg(F.greatest("d", "k_distance")) + 1e-10)).alias("density"))
    )
    other_density = density.select(F.col("row_id").alias("place"), F.col("density").alias("other_density"))
    scores = (
        others.join(other_density, "place").groupBy("row_id").agg(F.avg("other_density").alias("m"))
        .join(density, "row_id").select(F.col("row_id").alias("loc"), (-F.col("m") / F.col("density")).alias("score"))
    )
    rows = points.select("row_id", _array(columns).alias("x"))
    places = rows.join(scores, rows["row_id"] == scores["loc"]).select("x", "score")
    return rows.join(places, "x").select("row_id", "score")
