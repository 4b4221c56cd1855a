import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from openstat.operators import blocks, clusters, models, outliers
from openstat.operators.profile import TableProfile


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(42)
    x = np.vstack([rng.normal(c, 0.4, size=(100, 3)) for c in (0.0, 5.0, 10.0)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, x double, y double, z double")
    return clusters.cut_lineage(clusters.standardize(df, ["x", "y", "z"]))


COLUMNS = ["x", "y", "z"]


def _matrix(df):
    return df.orderBy("row_id").select(*COLUMNS).toPandas().to_numpy()


def test_kmeans_finds_three_groups(blobs):
    best = clusters.choose_k(blobs, COLUMNS, 300).first()
    assert best.k == 3 and best.silhouette > 0.7


def test_kmeans_settles_on_the_means_of_its_clusters(blobs):
    centers = clusters.fit_kmeans(blobs, COLUMNS, range(3, 4))[3]
    x = _matrix(blobs)
    label = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.allclose([x[label == c].mean(axis=0) for c in range(3)], centers, atol=1e-2)


def test_kmeans_fits_alike_with_few_and_many_draws(blobs):
    few = clusters.fit_kmeans(blobs, COLUMNS, range(3, 4), per_draw=8, draws=2)[3]
    many = clusters.fit_kmeans(blobs, COLUMNS, range(3, 4))[3]
    assert np.allclose(few[np.argsort(few[:, 0])], many[np.argsort(many[:, 0])], atol=1e-6)


def test_first_centers_see_a_cluster_of_one_row_in_twenty_thousand(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (20_000, 2)), rng.normal(40, 1, (19_998, 2)), [[300.0, -300.0], [301.0, -300.0]]])
    table = spark.createDataFrame(pd.DataFrame(x, columns=["x", "y"]).rename_axis("row_id").reset_index()).repartition(7)
    drawn, weight = clusters.draw_centers(table, ["x", "y"], 42, 16, 3)
    assert len(drawn) <= 1 + 16 * 3 and weight.sum() == len(x)
    nearest = ((x[:, None] - drawn[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.array_equal(np.bincount(nearest, minlength=len(drawn)), weight)
    again, _ = clusters.draw_centers(table.repartition(3), ["x", "y"], 42, 16, 3)
    assert np.array_equal(drawn, again)
    centers = clusters.fit_kmeans(table, ["x", "y"], range(3, 4), restarts=2)[3]
    assert np.allclose(sorted(centers[:, 0]), [0, 40, 300.5], atol=0.1)


def test_draws_stop_when_every_row_is_drawn(spark):
    same = spark.createDataFrame([(i, 1.0 + i % 2) for i in range(50)], "row_id long, x double")
    drawn, weight = clusters.draw_centers(same, ["x"], 1, 8, 5)
    assert drawn.tolist() == [[1.0], [2.0]] and weight.tolist() == [25, 25]
    none, _ = clusters.draw_centers(same.where("x > 9"), ["x"], 1, 8, 5)
    assert len(none) == 0


def test_nearest_centers_far_from_the_origin():
    x = np.array([[1e8], [1e8 + 1], [1e8 + 3]])
    label, gap = clusters._assign(x, np.array([[1e8], [1e8 + 3]]))
    assert label.tolist() == [0, 0, 1] and gap.tolist() == [0, 1, 0]


def test_silhouette_over_several_blocks(blobs, monkeypatch):
    monkeypatch.setattr("openstat.operators.blocks.BLOCK_ROWS", 70)
    labeled = clusters.kmeans_labels(blobs, COLUMNS, range(2, 4))
    got = {r.labeling: r.silhouette for r in clusters.mean_silhouette(labeled, COLUMNS, ["k2", "k3"], 300).collect()}
    x = _matrix(blobs)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for name in ("k2", "k3"):
        label = labeled.orderBy("row_id").toPandas()[name].to_numpy()
        s = []
        for i in range(300):
            means = {c: d[i, label == c].sum() / (np.sum(label == c) - (c == label[i])) for c in set(label)}
            a = means.pop(label[i])
            s.append((min(means.values()) - a) / max(a, min(means.values())))
        assert got[name] == pytest.approx(np.mean(s))


def test_distance_sums_of_near_far_and_missing_points():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(40, 3)) + 1e6, rng.normal(size=(60, 3)) + 1e6
    b[:20], b[20] = a[:20], 1e9
    codes = np.column_stack([rng.integers(-1, 2, 60), rng.integers(2, 5, 60)]).astype("int32")

    def want():
        d = blocks.distances(a, b)
        return np.column_stack([d[:, (codes == c).any(axis=1)].sum(axis=1) for c in range(5)])

    assert np.allclose(blocks.distance_sums(a, b, codes, 5), want(), rtol=1e-12)
    assert (blocks.distance_sums(np.ones((9, 2)), np.ones((7, 2)), np.zeros((7, 1), "int32"), 1) == 0).all()
    b[30], codes[30] = np.nan, (-1, 3)
    got = blocks.distance_sums(a, b, codes, 5)
    assert np.isnan(got[:, 3]).all() and np.allclose(got, want(), rtol=1e-12, equal_nan=True)


def test_a_block_is_moved_as_one_row(spark, monkeypatch):
    moved = []
    monkeypatch.setattr(blocks, "cut_lineage", lambda df: moved.append(df.localCheckpoint()) or moved[-1])
    points = spark.range(5000).select(
        F.col("id").alias("row_id"), F.array(F.col("id").cast("double")).alias("x"), F.array(F.lit(0)).alias("codes")
    )
    sums = {r["row_id"]: r["t"] for r in blocks.label_sums(points, 5000, 1, 1).groupBy("row_id").agg(F.sum("s0").alias("t")).collect()}
    assert moved[0].count() == 5 and len(sums) == 5000
    assert sums[0] == 4999 * 5000 / 2 and sums[4999] == sums[0] and sums[2500] == 2500 * 2501 / 2 + 2499 * 2500 / 2


def test_density_clusters_over_several_blocks(blobs, monkeypatch):
    monkeypatch.setattr("openstat.operators.blocks.BLOCK_ROWS", 70)
    rows = clusters.density_clusters(blobs, COLUMNS, 300, eps=0.3).collect()
    labels = {r.label for r in rows if r.label is not None}
    assert len(labels) == 3 and sum(r.label is None for r in rows) < 15


def test_local_outliers_against_brute_force(blobs, monkeypatch):
    monkeypatch.setattr("openstat.operators.blocks.BLOCK_ROWS", 70)
    x, k = _matrix(blobs), 10
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :k]
    kd = np.take_along_axis(d, near, 1)[:, -1]
    reach = np.maximum(np.take_along_axis(d, near, 1), kd[near])
    density = 1 / (reach.mean(axis=1) + 1e-10)
    want = -(density[near].mean(axis=1) / density)
    got = outliers.local_outlier_factor(blobs, COLUMNS, 300, k).orderBy("row_id").toPandas()["score"].to_numpy()
    assert np.allclose(got, want)


def test_forest_paths_with_missing_values():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    tree = outliers._grow(0, x[:256], 1)
    nodes = {n["node"]: n for n in tree.to_dict("records")}
    x[5, 0], x[6] = np.nan, np.nan
    want = []
    for row in x:
        n = nodes[0]
        while n["feature"] >= 0:
            n = nodes[n["low"] if row[n["feature"]] <= n["threshold"] else n["high"]]
        want.append(n["depth"] + outliers._average_path(n["size"]))
    levels = outliers._levels(tree.sort_values("node").reset_index(drop=True))
    assert len(levels[0]) == 8 and outliers._path_total(x, [levels, levels]).tolist() == [2 * w for w in want]


def test_kept_columns_need_no_join(spark):
    df = spark.createDataFrame([(i, float(i % 7), "ab"[i % 2]) for i in range(400)], "row_id long, x double, kind string")
    forest = outliers.train_forest(df, ["x"])
    rows = outliers.isolation_scores(df, ["x"], forest, keep=("kind",)).collect()
    assert len(rows) == 400 and all(r["kind"] == "ab"[r["row_id"] % 2] for r in rows)


def test_moves_of_all_models_at_once():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    models = {(k, r): rng.normal(size=(k, 3)) for k in (2, 4) for r in range(3)}
    got = clusters._moves(x, models)
    for (k, r), centers in models.items():
        label = clusters._assign(x, centers)[0]
        for c in range(k):
            assert np.allclose(got[k, r, c], [*x[label == c].sum(axis=0), (label == c).sum()])


def test_planted_outliers_are_isolated(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 3))
    x[:10] += 9
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, x double, y double, z double")
    forest = outliers.train_forest(df, COLUMNS)
    sizes = forest.where("node = 0").select("size").distinct().collect()
    assert forest.select("tree").distinct().count() == 100 and [r["size"] for r in sizes] == [256]
    flagged = outliers.flag_lowest(outliers.isolation_scores(df, COLUMNS, forest)).where("unusual").collect()
    assert len(flagged) == 40 and set(range(10)) <= {r.row_id for r in flagged}


def test_components_of_two_columns(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=400)
    b = a + rng.normal(size=400)
    df = clusters.standardize(spark.createDataFrame([(float(p), float(q)) for p, q in zip(a, b)], "x double, y double"), ["x", "y"])
    assert clusters.explained_variance(df, ["x", "y"])[0] == pytest.approx((1 + abs(np.corrcoef(a, b)[0, 1])) / 2)


def test_suite_order_and_gates(spark, blobs):
    table = blobs.drop("row_id")
    profile = TableProfile("Blobs", "b", 300, [{"name": c, "kind": "numeric"} for c in COLUMNS])
    found = [r.type for r in models.model_findings(table, profile, restarts=2).collect()]
    assert found[:1] == ["kmeans_cluster"] and "pca_structure" in found and found[-1] in ("anomaly_top_rows", "lof_anomaly")
    small = TableProfile("Blobs", "b", 50, profile.columns)
    assert models.model_findings(table.limit(50), small).count() == 0
