"""Exact neighbours in space cells, density clusters and local outliers on awkward shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from openstat.operators import clusters, outliers, space


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    names = [f"c{i}" for i in range(x.shape[1])]
    rows = [(int(i), *map(float, r)) for i, r in zip(ids, x)]
    return spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{n} double" for n in names)).repartition(4), names


def brute_outliers(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d))[:, :k]
    reach = np.take_along_axis(d, near, 1)
    density = 1 / (np.maximum(reach, reach[:, -1][near]).mean(axis=1) + 1e-10)
    return -(density[near].mean(axis=1) / density)


def crowded(seed=4, n=1500):
    """Nine tenths of the rows in one dense cell, the rest far and wide; some places hold many rows."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[: n * 9 // 10] *= 1e-3
    x[n - 40 :] = x[0]
    x[n - 60 : n - 40] = x[n - 100]
    return rng.permutation(x)


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(space, "CELL_ROWS", 60)
    monkeypatch.setattr(space, "LEAST_ROWS", 60)


@pytest.mark.parametrize("k", [5, 30])
def test_local_outliers_of_a_crowded_table(spark, small_cells, k):
    x = crowded()
    df, names = table(spark, x)
    got = outliers.local_outlier_factor(df, names, len(x), k).orderBy("row_id").toPandas()
    assert got["row_id"].tolist() == list(range(len(x)))
    assert np.allclose(got["score"], brute_outliers(x, k), rtol=1e-6)


def test_cells_of_a_crowded_table_are_even(spark, small_cells):
    x = crowded()
    df, names = table(spark, x)
    places = space.distinct_points(df.select("row_id", F.array(*names).alias("x")))
    cells = space.in_cells(places, 3)
    counts = [r["count"] for r in cells.points.groupBy("cell").count().collect()]
    assert sum(counts) == len(np.unique(x, axis=0)) and len(counts) > 15 and max(counts) < 400


def test_neighbours_travel_to_few_cells(spark, small_cells):
    """Of uniform points in the plane a search visits its own cell and a few near ones."""
    x = np.random.default_rng(1).uniform(size=(3000, 2))
    df, names = table(spark, x)
    near = outliers.nearest_places(df, names, 4).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = np.sort(d, axis=1)[:, :4]
    got = near.sort_values(["row_id", "d"]).groupby("row_id")["d"].apply(list)
    assert np.allclose(np.array(got.tolist()), want)


def test_outliers_of_tiny_tables(spark):
    one, names = table(spark, np.zeros((1, 2)))
    assert outliers.local_outlier_factor(one, names, 1, 5).count() == 0
    same, names = table(spark, np.ones((30, 2)))
    assert {round(r["score"], 6) for r in outliers.local_outlier_factor(same, names, 30, 5).collect()} == {-1.0}
    few, names = table(spark, np.array([[0.0, 0], [1, 0], [5, 0]]))
    assert outliers.local_outlier_factor(few, names, 3, 5).count() == 3
    assert outliers.local_outlier_factor(few.limit(0), names, 0, 5).count() == 0


def brute_density(x, eps, need):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= need
    label = np.where(core, np.arange(len(x)), -1)
    for i in np.flatnonzero(core):
        if label[i] == i:
            todo = [i]
            while todo:
                j = todo.pop()
                for m in np.flatnonzero(near[j] & core & (label > i)):
                    label[m] = i
                    todo.append(m)
    for i in np.flatnonzero(~core):
        own = label[near[i] & core]
        label[i] = own.min() if len(own) else -1
    return [(i, bool(c), None if v < 0 else int(v)) for i, (c, v) in enumerate(zip(core, label))]


@pytest.mark.parametrize("eps,need", [(0.4, 5), (0.002, 12), (3.0, 2000)])
def test_density_clusters_equal_brute_force(spark, small_cells, eps, need):
    x = crowded(seed=8, n=900)
    df, names = table(spark, x)
    got = clusters.density_clusters(df, names, len(x), eps=eps, min_samples=need).orderBy("row_id").collect()
    assert [tuple(r) for r in got] == brute_density(x, eps, need)


def test_a_chain_of_cells_is_one_cluster(spark):
    """Far more links than any fixed number of rounds over neighbours could follow."""
    x = np.c_[np.arange(1500) * 0.35, np.zeros(1500)]
    df, names = table(spark, x, ids=np.random.default_rng(2).permutation(1500))
    got = clusters.density_clusters(df, names, 1500, eps=0.4, min_samples=2)
    assert [r["label"] for r in got.select("label").distinct().collect()] == [0]


def test_density_clusters_of_nothing(spark):
    df, names = table(spark, np.zeros((3, 2)))
    assert clusters.density_clusters(df.limit(0), names, 0).count() == 0
    assert {r["label"] for r in clusters.density_clusters(df, names, 3).collect()} == {None}


def test_no_table_of_point_pairs(spark):
    x = np.random.default_rng(3).normal(size=(200, 2))
    df, names = table(spark, x)
    plan = clusters.density_clusters(df, names, 200)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "FlatMapCoGroups" not in plan
