"""Exploratory models as findings, in fixed order, on the same rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from openstat import rules
from openstat.operators import clusters, outliers
from openstat.operators.profile import TableProfile
from openstat.operators.sampling import model_sample
from openstat.schemas import FINDING


def model_points(df: DataFrame, columns: list[str], cap: int | None = None):
    """Standardized rows (of a sample, if capped) with row ids, and their number."""
    rows = clusters.with_row_id(clusters.standardize(model_sample(df, columns, cap), columns))
    return rows, rows.count()


def kmeans_finding(points: DataFrame, columns: list[str], n: int, restarts: int = 10) -> dict | None:
    best = clusters.choose_k(points, columns, n, restarts).first()
    if best is None or best["silhouette"] < rules.MIN_SILHOUETTE:
        return None
    k, s = best["k"], best["silhouette"]
    return {
        "type": "kmeans_cluster", "method": "kmeans", "value": s, "n": n,
        "title": f"K-means found {k} clusters (silhouette = {s:.2f}, n = {n})",
        "caveat": "clusters are exploratory patterns in numeric fields — not causal groups",
        "details": {"k": k, "silhouette": s},
    }


def density_finding(points: DataFrame, columns: list[str], n: int) -> dict | None:
    labeled = clusters.cut_lineage(clusters.density_clusters(points, columns, n).join(points, "row_id"))
    kept = labeled.where("label is not null")
    shape = kept.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("k")).first()
    if shape["k"] < 2 or shape["n"] < rules.ML_MIN_ROWS:
        return None
    s = clusters.mean_silhouette(kept, columns, ["label"], shape["n"]).first()["silhouette"]
    if s < rules.MIN_SILHOUETTE:
        return None
    return {
        "type": "dbscan_cluster", "method": "dbscan", "value": s, "n": shape["n"],
        "title": f"DBSCAN found {shape['k']} density clusters (silhouette = {s:.2f})",
        "caveat": "density clusters may include noise points; interpret with domain context",
        "details": {"n_clusters": shape["k"], "noise_pct": round(1 - shape["n"] / n, 4)},
    }


def pca_finding(points: DataFrame, columns: list[str], n: int) -> dict | None:
    ratios = clusters.explained_variance(points, columns)
    if ratios[0] < rules.MIN_PCA_VARIANCE:
        return None
    return {
        "type": "pca_structure", "method": "pca", "value": ratios[0], "n": n,
        "title": f"First principal component explains {ratios[0]:.0%} of numeric variation",
        "caveat": "PCA summarizes correlation structure — not a significance test",
        "details": {"explained_variance_ratio": [round(r, 4) for r in ratios]},
    }


def _outlier_finding(scored: DataFrame, n: int, kind: str, method: str, title: str, caveat: str) -> dict | None:
    flagged = outliers.flag_lowest(clusters.cut_lineage(scored)).where("unusual").count()
    rate = flagged / n
    if flagged == 0 or rate < 0.005:
        return None
    return {
        "type": kind, "method": method, "value": rate, "n": n,
        "title": title.format(flagged=flagged, rate=rate, n=n), "caveat": caveat,
        "details": {"anomaly_count": flagged},
    }


def isolation_finding(points: DataFrame, columns: list[str], n: int) -> dict | None:
    forest = outliers.train_forest(points, columns)
    return _outlier_finding(
        outliers.isolation_scores(points, columns, forest), n, "anomaly_top_rows", "isolation_forest",
        "Isolation Forest flagged {flagged} unusual rows ({rate:.1%} of n = {n})",
        "unusual rows may be data quality issues or rare valid cases",
    )


def local_outlier_finding(points: DataFrame, columns: list[str], n: int) -> dict | None:
    return _outlier_finding(
        outliers.local_outlier_factor(points, columns, n), n, "lof_anomaly", "lof",
        "Local Outlier Factor flagged {flagged} unusual rows ({rate:.1%})",
        "local outliers are relative to nearby rows — verify before treating as errors",
    )


def model_findings(df: DataFrame, profile: TableProfile, cap: int | None = None,
                   restarts: int = 10, columns: int = 8) -> DataFrame:
    """K-means, density clusters, components, isolation forest, local outliers.

    All rows take part unless the caller sets a cap, and the first `columns` numeric columns.
    """
    spark, columns = df.sparkSession, profile.of_kind("numeric")[:columns]
    found: list[dict | None] = []
    if len(columns) >= 2 and profile.n_rows >= 100:
        points, n = model_points(df, columns, cap)
        clustering = profile.n_rows >= rules.ML_ROW_GATE and n >= rules.ML_MIN_ROWS
        if clustering:
            found.append(kmeans_finding(points, columns, n, restarts))
            found.append(density_finding(points, columns, n))
            found.append(pca_finding(points, columns, n))
        if n >= 100:
            found.append(isolation_finding(points, columns, n))
            found.append(local_outlier_finding(points, columns, n))
    rows = [
        (
            f["type"], f["title"], columns, round(float(f["value"]), 4), None, int(f["n"]), f["method"],
            f["caveat"], "SELECT " + ", ".join(f"`{c}`" for c in columns) + " FROM data",
            [profile.resource_id], abs(float(f["value"])),
            json.dumps({"dataset_title": profile.title, **f["details"]}),
        )
        for f in found if f
    ]
    return spark.createDataFrame(rows, FINDING)
