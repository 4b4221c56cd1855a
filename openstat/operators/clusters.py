"""Standardization, k-means, silhouette, density clusters and principal components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from openstat.operators.blocks import distances, label_sums
from openstat.operators.space import distinct_points, in_cells, matrix, meet
from openstat.session import cut_lineage, store


#: squared movement of all centers of a model below which it has settled
_TOLERANCE = 1e-4
#: scores of points under centers that are held at once
_SCORES = 1 << 16


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column is only centered. One aggregate."""
    stats = df.agg(
        *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return df.withColumns(
        {
            c: (F.col(f"`{c}`") - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0)
            for i, c in enumerate(columns)
        }
    )


def with_row_id(df: DataFrame) -> DataFrame:
    """Rows written once with an id, so every later step sees the same ids."""
    return cut_lineage(df.withColumn("row_id", F.monotonically_increasing_id()))


def _array(columns: list[str]):
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns])


def _matrix(block: pd.DataFrame) -> np.ndarray:
    return np.vstack(block["x"].to_numpy())


def silhouettes(points: DataFrame, columns: list[str], label_columns: list[str], n_rows: int) -> DataFrame:
    """Per point and labeling: Euclidean silhouette. `points` carries row_id and label columns.

    A block of points and a strip of others return, per point, the distance sum to every cluster
    of every labeling; a point alone in its cluster scores 0.
    """
    sizes = {
        c: {r[c]: r["count"] for r in points.groupBy(c).count().collect()} for c in label_columns
    }  # a few clusters per labeling
    clusters = [(c, k) for c in label_columns for k in sorted(sizes[c])]
    names = [f"s{i}" for i in range(len(clusters))]

    codes = [
        F.coalesce(*[F.when(F.col(c) == k, i) for i, (cc, k) in enumerate(clusters) if cc == c], F.lit(-1)) for c in label_columns
    ]
    coded = points.select("row_id", _array(columns).alias("x"), F.array(*codes).alias("codes"))
    totals = cut_lineage(
        label_sums(coded, n_rows, len(columns), len(clusters)).groupBy("row_id").agg(*[F.sum(n).alias(n) for n in names])
    )
    joined = totals.join(points.select("row_id", *label_columns), "row_id")
    out = []
    for c in label_columns:
        own = F.coalesce(
            *[
                F.when(F.col(c) == k, F.try_divide(F.col(n), F.lit(sizes[c][k] - 1)))
                for n, (cc, k) in zip(names, clusters) if cc == c
            ]
        )
        others = [
            F.when(F.col(c) != k, F.col(n) / F.lit(sizes[c][k]))
            for n, (cc, k) in zip(names, clusters) if cc == c
        ]
        nearest = F.least(*others) if len(others) > 1 else others[0]
        value = F.when(own.isNull() | nearest.isNull(), 0.0).otherwise(
            F.coalesce(F.try_divide(nearest - own, F.greatest(own, nearest)), F.lit(0.0))
        )
        out.append(
            F.struct(F.lit(c).alias("labeling"), F.col(c).cast("bigint").alias("label"), value.alias("silhouette"))
        )
    return joined.select("row_id", F.inline(F.array(*out)))


def mean_silhouette(points: DataFrame, columns: list[str], label_columns: list[str], n_rows: int) -> DataFrame:
    """(labeling, clusters, n, silhouette)."""
    return silhouettes(points, columns, label_columns, n_rows).groupBy("labeling").agg(
        F.countDistinct("label").alias("clusters"), F.count(F.lit(1)).alias("n"),
        F.avg("silhouette").alias("silhouette"),
    )


def squared_silhouette(labeled: DataFrame, features: str, label: str) -> float:
    """Linear-cost variant on squared distances, for tables too large for exact pairs."""
    return ClusteringEvaluator(featuresCol=features, predictionCol=label).evaluate(labeled)


def _seed_centers(drawn: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ on weighted points: each next center is drawn by weight and squared distance."""
    centers = [drawn[rng.choice(len(drawn), p=weight / weight.sum())]]
    for _ in range(k - 1):
        gap = weight * np.min([((drawn - c) ** 2).sum(axis=1) for c in centers], axis=0)
        total = gap.sum()
        pick = rng.choice(len(drawn), p=gap / total) if total > 0 else rng.integers(len(drawn))
        centers.append(drawn[pick])
    return np.array(centers)


def _assign(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest center and squared distance to it. The product only compares; the distance is exact."""
    middle = centers.mean(axis=0)  # keeps the product's terms small far from the origin
    near = centers - middle
    square, label, step = (near**2).sum(axis=1), np.empty(len(x), "int64"), max(1, _SCORES // len(centers))
    for at in range(0, len(x), step):
        label[at : at + step] = (square - 2.0 * ((x[at : at + step] - middle) @ near.T)).argmin(axis=1)
    return label, ((x - centers[label]) ** 2).sum(axis=1)


def draw_centers(packed: DataFrame, columns: list[str], seed: int, per_round: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Points drawn from all rows by their distance to those drawn before, and the rows nearest to each.

    A round is one pass: a row's key is an exponential variate from its hash divided by its squared
    distance, and the `per_round` smallest keys are a draw without replacement weighted by
    distance. A task returns at most `per_round` rows, so the driver holds at most
    1 + per_round * rounds points at any table size. The draws repeat for the same rows and ids. Rows
    that equal a drawn point are never drawn again; an empty table gives no points.
    """
    schema = "key double, " + ", ".join(f"x{i} double" for i in range(len(columns)))
    names = [f"x{i}" for i in range(len(columns))]
    hashed = [
        packed.select(F.xxhash64(F.lit(seed), F.lit(r), "row_id").alias("hash"), *[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)])
        for r in range(rounds + 1)
    ]
    first = hashed[0].orderBy("hash", *names).limit(1).toPandas()[names].to_numpy(dtype="float64")
    if not len(first):
        return first, np.zeros(0)
    drawn = first
    for one in hashed[1:]:

        def keys(batches, drawn=drawn):
            best = np.empty((0, len(names) + 1))
            for batch in batches:
                x = batch[names].to_numpy(dtype="float64")
                gap = _assign(x, drawn)[1]
                far = gap > 0
                u = ((batch["hash"].to_numpy().astype("uint64") >> np.uint64(11)).astype("float64") + 0.5) / 2.0**53
                key = -np.log(u[far]) / gap[far]
                best = np.vstack([best, np.column_stack([key, x[far]])])
                best = best[np.lexsort(best.T[::-1])][:per_round]
            yield pd.DataFrame(best, columns=["key", *names])

        more = one.mapInPandas(keys, schema).orderBy("key", *names).limit(per_round).toPandas()
        if not len(more):
            break
        drawn = np.unique(np.vstack([drawn, more[names].to_numpy()]), axis=0)

    def nearest(batches):
        count = np.zeros(len(drawn), dtype="int64")
        for batch in batches:
            count += np.bincount(_assign(batch[names].to_numpy(dtype="float64"), drawn)[0], minlength=len(drawn))
        yield pd.DataFrame({"point": np.arange(len(drawn)), "n": count})

    weight = np.zeros(len(drawn))
    counted = hashed[0].mapInPandas(nearest, "point int, n long").groupBy("point").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # a row per drawn point
        weight[r["point"]] = r["n"]
    return drawn, weight


def fit_kmeans(points: DataFrame, columns: list[str], ks: range, restarts: int = 10, seed: int = 42,
               max_rounds: int = 100, per_draw: int = 64, draws: int = 5) -> dict[int, np.ndarray]:
    """Centers per k: the restart with the least inertia.

    All k and all restarts move together: one pass over the data per round returns
    sums per (model, cluster), a few hundred rows in all, instead of one pass per
    round and model. The rows are packed once and their inertia is taken in one last
    pass. Models that stopped moving are left out. First centers are chosen among
    points that `draw_centers` takes from all rows, so a small cluster far from the rest is seen.
    """
    packed = points.select("row_id", *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).persist()
    drawn, weight = draw_centers(packed, columns, seed, per_draw, draws)
    models = {
        (k, r): _seed_centers(drawn, weight, k, np.random.default_rng([seed, k, r]))
        for k in ks for r in range(restarts)
    }
    width = len(columns)
    origin = drawn.mean(axis=0) if len(drawn) else np.zeros(width)  # keeps the products' terms small
    pieces = _pieces(packed.drop("row_id"), origin).persist()
    rated = dict(models)  # the centers whose cost counts: those before the last move
    moving = sorted(models)
    for done in range(max_rounds):
        current = {m: models[m] - origin for m in moving}
        rows = _sum_pieces(pieces, width, lambda x, current=current: _moves(x, current), width + 1)
        if not done:
            packed.unpersist()
        fresh = {m: models[m].copy() for m in moving}
        for (k, r, c), total in rows.items():
            if total[-1]:
                fresh[k, r][c] = origin + total[:-1] / total[-1]
        still = []
        for m in moving:
            rated[m] = models[m]
            if ((fresh[m] - models[m]) ** 2).sum() > _TOLERANCE:
                still.append(m)
            models[m] = fresh[m]
        moving = still
        if not moving:
            break
    current = {m: c - origin for m, c in rated.items()}
    costs = _sum_pieces(pieces, width, lambda x: {(*m, 0): _assign(x, c)[1].sum(keepdims=True) for m, c in current.items()}, 1)
    inertia = {m: costs[*m, 0][0] if (*m, 0) in costs else 0.0 for m in models}
    pieces.unpersist()
    return {k: models[min((m for m in models if m[0] == k), key=lambda m: (inertia[m], m))] for k in ks}


#: rows of a piece: its scores under some thirty centers stay in a core's cache
_PIECE_ROWS = 4_096


def _pieces(rows: DataFrame, origin: np.ndarray) -> DataFrame:
    """The rows less `origin` as pieces of doubles, so that a round reads them without converting a value."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns]) - origin
            held = [x[at : at + _PIECE_ROWS].tobytes() for at in range(0, len(x), _PIECE_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["x"])

    return rows.mapInArrow(pack, "x binary")


def _sum_pieces(pieces: DataFrame, dims: int, sums, width: int) -> dict[tuple[int, int, int], np.ndarray]:
    """`sums` of a piece gives arrays by (k, restart, cluster); they are added up over all pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for piece in batch.column(0):
                x = np.frombuffer(piece.as_buffer(), "float64").reshape(-1, dims)
                for key, part in sums(x).items():
                    out[key] = out[key] + part if key in out else part
        keys = [pa.array([key[i] for key in out], pa.int32()) for i in range(3)]
        total = pa.array([part.tolist() for part in out.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*keys, total], ["k", "restart", "cluster", "total"])

    added = pieces.mapInArrow(run, "k int, restart int, cluster int, total array<double>").groupBy("k", "restart", "cluster").agg(
        F.array(*[F.sum(F.element_at("total", i)) for i in range(1, width + 1)]).alias("total")
    )
    return {(r["k"], r["restart"], r["cluster"]): np.array(r["total"]) for r in added.collect()}  # a row per center


def _moves(x: np.ndarray, models: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int, int], np.ndarray]:
    """Per (k, restart, cluster): sums of the coordinates of the points nearest to the center, and their number.

    All models with the same k are scored by one product, a row of scores per center.
    """
    out = {}
    ones = np.column_stack([x, np.ones(len(x))])
    for k in {k for k, _ in models}:
        names = [m for m in models if m[0] == k]
        centers = np.concatenate([models[m] for m in names])
        scores = np.column_stack([-2.0 * centers, (centers**2).sum(axis=1)]) @ ones.T
        scores = scores.reshape(len(names), k, len(x))
        best, label = scores[:, 0].copy(), np.zeros((len(names), len(x)), "int8" if k < 128 else "int32")
        for c in range(1, k):
            np.putmask(label, scores[:, c] < best, c)
            np.minimum(best, scores[:, c], out=best)
        for c in range(k):
            total = (label == c).astype("float64") @ ones
            out |= {(*m, c): total[i] for i, m in enumerate(names)}
    return out


def kmeans_labels(points: DataFrame, columns: list[str], ks: range, restarts: int = 10, seed: int = 42) -> DataFrame:
    """Adds one label column k2, k3, ... per k."""
    best = fit_kmeans(points, columns, ks, restarts, seed)
    schema = T.StructType([*points.schema.fields, *[T.StructField(f"k{k}", T.IntegerType()) for k in ks]])

    def label(batches):
        for batch in batches:
            if len(batch):
                x = batch[columns].to_numpy(dtype="float64")
                yield batch.assign(**{f"k{k}": _assign(x, best[k])[0].astype("int32") for k in ks})

    return cut_lineage(points.mapInPandas(label, schema))


def choose_k(points: DataFrame, columns: list[str], n_rows: int, restarts: int = 10, seed: int = 42) -> DataFrame:
    """(k, clusters, n, silhouette) for k = 2..5, best silhouette first."""
    ks = range(2, min(6, n_rows))
    labeled = kmeans_labels(points, columns, ks, restarts, seed)
    scores = mean_silhouette(labeled, columns, [f"k{k}" for k in ks], n_rows)
    return scores.select(
        F.expr("cast(substring(labeling, 2) as int)").alias("k"), "clusters", "n", "silhouette"
    ).orderBy(F.desc("silhouette"), "k")


def _count_near(need: int):
    """How many points lie within a visitor's radius, counted no further than `need`."""

    def run(leaves, points, x, visitors, radius) -> Iterator[pa.RecordBatch]:
        weight, near = points["n"].to_numpy(), np.zeros(len(x), np.int64)
        for visitor, point, _ in leaves.pairs(x, radius):
            near += np.bincount(visitor, weights=weight[point], minlength=len(x)).astype(np.int64)
            radius[near >= need] = -1
        row_id = visitors.column(visitors.schema.get_field_index("row_id"))
        yield pa.RecordBatch.from_arrays([row_id, pa.array(near)], ["row_id", "near"])

    return run


class _Nodes:
    """Points by the name of their small cell, with the box of each."""

    def __init__(self, names: pa.Array, x: np.ndarray) -> None:
        coded = names.dictionary_encode()
        self.names, code = np.asarray(coded.dictionary.to_pylist(), object), coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(self.names)))
        self.x = np.split(x[order], starts[1:])
        self.low, self.high = np.minimum.reduceat(x[order], starts), np.maximum.reduceat(x[order], starts)


def _touching(eps: float):
    """Pairs of small cells, the smaller name first, that hold points within eps of each other.

    Boxes decide most pairs; the points of a pair are compared only where they do not,
    and only until one is near enough.
    """

    def near(a: np.ndarray, b: np.ndarray) -> bool:
        step = max(1, (1 << 16) // len(b))
        return any((distances(a[i : i + step], b) <= eps).any() for i in range(0, len(a), step))

    def run(leaves, points, x, visitors, radius) -> Iterator[pa.RecordBatch]:
        here = _Nodes(points["node"].combine_chunks(), matrix(points["x"].combine_chunks(), x.shape[1]))
        there = _Nodes(visitors.column(visitors.schema.get_field_index("node")), x)
        first, second = [], []
        step = max(1, (1 << 20) // len(here.names))
        for at in range(0, len(there.names), step):
            gap, far = np.zeros((2, len(there.names[at : at + step]), len(here.names)))
            for d in range(x.shape[1]):
                low, high = there.low[at : at + step, d][:, None], there.high[at : at + step, d][:, None]
                gap += np.square(np.maximum(np.maximum(here.low[:, d] - high, low - here.high[:, d]), 0))
                far += np.square(np.maximum(here.high[:, d] - low, high - here.low[:, d]))
            maybe = (gap * (1 - 1e-12) <= eps * eps) & (there.names[at : at + step][:, None] < here.names)
            sure = far * (1 + 1e-12) <= eps * eps
            for i, j in zip(*np.nonzero(maybe)):
                if sure[i, j] or near(there.x[at + i], here.x[j]):
                    first.append(there.names[at + i])
                    second.append(here.names[j])
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.string()), pa.array(second, pa.string())], ["a", "b"])

    return run


def _first_label(leaves, points, x, visitors, radius) -> Iterator[pa.RecordBatch]:
    """The smallest label among the points within a visitor's radius."""
    own, label = points["label"].to_numpy(), np.full(len(x), np.iinfo(np.int64).max)
    for visitor, point, _ in leaves.pairs(x, radius):
        np.minimum.at(label, visitor, own[point])
    hit = label < np.iinfo(np.int64).max
    row_id = visitors.column(visitors.schema.get_field_index("row_id"))
    yield pa.RecordBatch.from_arrays([row_id.filter(pa.array(hit)), pa.array(label[hit])], ["row_id", "label"])


def density_clusters(points: DataFrame, columns: list[str], n_rows: int, eps: float = 1.2,
                     min_samples: int | None = None) -> DataFrame:
    """(row_id, core, label): label is the smallest core row_id of the cluster, null for noise.

    Points at one place count with their number. Core points in one small cell of diagonal
    eps are always connected, and a small cell with enough points has core points only, so
    crowded cells are decided without a distance; the graph to solve has one
    node per occupied small cell and one edge per touching pair.
    """
    need = max(5, n_rows // 100) if min_samples is None else min_samples
    side = eps / float(np.sqrt(len(columns))) * (1 - 1e-9)
    rows = points.select("row_id", _array(columns).alias("x"))
    node = F.array_join(F.transform("x", lambda v: F.floor(v / side).cast("string")), ":")
    space = in_cells(distinct_points(rows).select("row_id", "x", "n", node.alias("node")), len(columns))
    radius = F.lit(float(eps)).alias("r")
    full = space.points.groupBy("node").agg((F.sum("n") >= need).alias("full"))
    judged = store(space.points.join(full, "node"))
    open_ = judged.where("not full").select("row_id", "x", "cell", radius)
    near = meet(open_, space, _count_near(need), "row_id long, near long").groupBy("row_id").agg(F.sum("near").alias("near"))
    marked = store(
        judged.join(near, "row_id", "left").withColumn("core", F.col("full") | (F.coalesce("near", F.lit(0)) >= need))
        .select("row_id", "x", "node", "cell", "core")
    )
    core = marked.where("core").drop("core")
    one_way = meet(core.select("row_id", "x", "cell", "node", radius), replace(space, points=core), _touching(eps), "a string, b string")
    pairs = store(one_way.distinct())
    start = core.groupBy("node").agg(F.min("row_id").alias("label"))
    itself = start.select(F.col("node").alias("a"), F.col("node").alias("b"))
    labels = connect(pairs.union(pairs.select("b", "a")).union(itself), start)
    labeled = store(core.join(labels, "node").select("row_id", "x", "cell", "label"))
    border = meet(
        marked.where("not core").select("row_id", "x", "cell", radius), replace(space, points=labeled), _first_label,
        "row_id long, label long",
    ).groupBy("row_id").agg(F.min("label").alias("label"))
    found = labeled.select("row_id", "label").unionByName(border)
    places = marked.select("row_id", "x", "core").join(found, "row_id", "left").select("x", "core", "label")
    return rows.join(places, "x").select("row_id", "core", "label")


def connect(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Smallest start label reachable from each node: neighbor minimum, then a jump along labels, to the fixed point.

    Edges run both ways and include self edges; each round is written to the
    shared folder, so a lost executor never replays earlier rounds.
    """
    labels = cut_lineage(start)
    while True:
        heard = (
            edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("heard"))
        )
        better = labels.join(heard, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "heard").alias("seen")
        )
        hops = better.groupBy(F.col("old").alias("seen")).agg(F.min("seen").alias("jump"))
        moved = cut_lineage(
            better.join(hops, "seen", "left").select(
                "node", "old", F.least("seen", F.coalesce("jump", "seen")).alias("label")
            )
        )
        labels = moved.select("node", "label")
        if moved.where("label < old").isEmpty():
            return labels


def explained_variance(df: DataFrame, columns: list[str]) -> list[float]:
    """Variance ratios of the first three principal components of standardized columns."""
    assembled = VectorAssembler(inputCols=columns, outputCol="features").transform(df)
    model = PCA(k=min(3, len(columns)), inputCol="features", outputCol="pc").fit(assembled)
    return [float(v) for v in model.explainedVariance]
