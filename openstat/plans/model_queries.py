"""Registered queries: standardization, clusters, components and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from openstat.operators import clusters, models, outliers
from openstat.operators.profile import TableProfile
from openstat.operators.sampling import model_sample
from openstat.plans.registry import query
from openstat.session import cut_lineage, read_table as t

_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "standardize",
    "WITH m AS (SELECT " + ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(_MEASURES)) + " FROM lineitem) SELECT l_returnflag, "
    + ", ".join(f"round(avg(({c} - m{i}) / s{i}), 8) AS mean_{i}, round(avg((({c} - m{i}) / s{i}) ** 2), 8) AS square_{i}" for i, c in enumerate(_MEASURES))
    + " FROM lineitem, m GROUP BY 1",
)
def standardize(spark, d):
    z = clusters.standardize(t(spark, d, "lineitem"), _MEASURES)
    return z.groupBy("l_returnflag").agg(
        *[F.round(F.avg(c), 8).alias(f"mean_{i}") for i, c in enumerate(_MEASURES)],
        *[F.round(F.avg(F.col(c) * F.col(c)), 8).alias(f"square_{i}") for i, c in enumerate(_MEASURES)],
    )


def _vectors(spark, d, dims, sample=None):
    """First dimensions of the embeddings as columns, with the vector id as row id."""
    e = t(spark, d, "embeddings").select(
        F.col("vec_id").alias("row_id"), "label", *[F.element_at("embedding", i + 1).cast("double").alias(f"x{i}") for i in range(dims)]
    )
    columns = [f"x{i}" for i in range(dims)]
    return cut_lineage(clusters.standardize(e, columns)), columns


def _z_sql(dims):
    cols = ", ".join(f"embedding[{i + 1}]::DOUBLE AS v{i}" for i in range(dims))
    stats = ", ".join(f"avg(v{i}) AS m{i}, stddev_pop(v{i}) AS s{i}" for i in range(dims))
    z = ", ".join(f"(v{i} - m{i}) / s{i} AS x{i}" for i in range(dims))
    return f"WITH e AS (SELECT vec_id AS id, label, {cols} FROM embeddings), m AS (SELECT {stats} FROM e), z AS (SELECT id, label, {z} FROM e, m)"


def _distance(dims, a="a", b="b"):
    return "sqrt(" + " + ".join(f"({a}.x{i} - {b}.x{i}) ** 2" for i in range(dims)) + ")"


@query(
    "silhouette",
    _z_sql(8) + f""", p AS (SELECT a.id, a.label AS own, b.label AS other, sum({_distance(8)}) AS s, count(*) AS c FROM z a JOIN z b ON a.id <> b.id GROUP BY ALL),
      v AS (SELECT id, own, max(s / c) FILTER (other = own) AS a, min(s / c) FILTER (other <> own) AS b FROM p GROUP BY ALL)
      SELECT own AS label, count(*) AS n, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM v GROUP BY 1""",
)
def silhouette(spark, d):
    points, columns = _vectors(spark, d, 8)
    rows = clusters.silhouettes(points, columns, ["label"], points.count())
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


@query("kmeans_choose_k")
def kmeans_choose_k(spark, d):
    points, columns = _vectors(spark, d, 8)
    return clusters.choose_k(points, columns, points.count())


@query("kmeans_whole_table")
def kmeans_whole_table(spark, d):
    """Every line clustered into three groups, scored by the linear-cost silhouette."""
    from pyspark.ml.feature import VectorAssembler

    points = clusters.with_row_id(clusters.standardize(t(spark, d, "lineitem").select(*_MEASURES), _MEASURES))
    labeled = clusters.kmeans_labels(points, _MEASURES, range(3, 4))
    score = clusters.squared_silhouette(
        VectorAssembler(inputCols=_MEASURES, outputCol="features").transform(labeled), "features", "k3"
    )
    return labeled.groupBy("k3").count().withColumn("silhouette", F.lit(score))


_DENSITY_SQL = _z_sql(3) + f""", n AS (SELECT a.id, count(*) >= 8 AS core FROM z a JOIN z b ON {_distance(3)} <= 0.6 GROUP BY 1),
  e AS (SELECT a.id AS a, b.id AS b, nb.core AS b_core FROM z a JOIN n na ON na.id = a.id JOIN z b ON {_distance(3)} <= 0.6 JOIN n nb ON nb.id = b.id WHERE na.core)"""
_DENSITY_SQL = _DENSITY_SQL.replace("WITH e AS (SELECT vec_id", "WITH RECURSIVE src AS (SELECT vec_id").replace("FROM e)", "FROM src)").replace("FROM e, m)", "FROM src, m)")


@query(
    "density_clusters",
    _DENSITY_SQL + """, r AS (SELECT id AS root, id AS node FROM n WHERE core UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.node AND e.b_core),
      cl AS (SELECT node AS id, min(root) AS label FROM r GROUP BY 1),
      bd AS (SELECT e.b AS id, min(cl.label) AS label FROM e JOIN cl ON cl.id = e.a WHERE NOT e.b_core GROUP BY 1)
      SELECT n.id AS row_id, n.core, coalesce(cl.label, bd.label) AS label FROM n LEFT JOIN cl ON cl.id = n.id LEFT JOIN bd ON bd.id = n.id""",
)
def density_clusters(spark, d):
    points, columns = _vectors(spark, d, 3)
    return clusters.density_clusters(points, columns, points.count(), eps=0.6, min_samples=8)


@query("pca_two_columns", "SELECT round((1 + abs(corr(l_quantity, l_extendedprice))) / 2, 8) AS pc1 FROM lineitem")
def pca_two_columns(spark, d):
    z = clusters.standardize(t(spark, d, "lineitem"), _MEASURES[:2])
    return spark.createDataFrame([(round(clusters.explained_variance(z, _MEASURES[:2])[0], 8),)], "pc1 double")


@query("pca_components")
def pca_components(spark, d):
    points, columns = _vectors(spark, d, 8)
    ratios = clusters.explained_variance(points, columns)
    return spark.createDataFrame([(i + 1, r) for i, r in enumerate(ratios)], "component int, ratio double")


@query("isolation_forest")
def isolation_forest(spark, d):
    """Unusual lines of the whole table, by return flag."""
    lines = t(spark, d, "lineitem").select("l_returnflag", *_MEASURES)
    points = clusters.with_row_id(clusters.standardize(lines, _MEASURES))
    forest = outliers.train_forest(points, _MEASURES)
    scored = cut_lineage(outliers.isolation_scores(points, _MEASURES, forest, keep=("l_returnflag",)))
    return outliers.flag_lowest(scored).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("unusual").alias("unusual"), F.min("score").alias("lowest")
    )


_LOF_SQL = """WITH m AS (SELECT avg(c_acctbal) AS m0, stddev_pop(c_acctbal) AS s0, avg(c_nationkey) AS m1, stddev_pop(c_nationkey) AS s1 FROM customer),
  z AS (SELECT c_custkey AS id, (c_acctbal - m0) / s0 AS x0, (c_nationkey - m1) / s1 AS x1 FROM customer, m),
  k AS (SELECT least(35, greatest(5, count(*) // 20)) AS k FROM z),
  d AS (SELECT a.id, b.id AS other, sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2) AS d FROM z a JOIN z b ON a.id <> b.id),
  nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS r FROM d) WHERE r <= (SELECT k FROM k)),
  kd AS (SELECT id, max(d) AS kd FROM nn GROUP BY 1),
  lrd AS (SELECT nn.id, 1.0 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.id = nn.other GROUP BY 1),
  lof AS (SELECT nn.id, -avg(o.lrd) / max(l.lrd) AS score FROM nn JOIN lrd o ON o.id = nn.other JOIN lrd l ON l.id = nn.id GROUP BY 1)"""


@query(
    "local_outlier_factor",
    _LOF_SQL + " SELECT id AS row_id, round(score, 6) AS score, score < (SELECT quantile_cont(score, 0.02) FROM lof) AS unusual FROM lof",
)
def local_outlier_factor(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    columns = ["c_acctbal", "c_nationkey"]
    sampled = model_sample(c, columns, key=["row_id"])
    points = cut_lineage(clusters.standardize(sampled, columns))
    scored = cut_lineage(outliers.local_outlier_factor(points, columns, points.count()))
    return outliers.flag_lowest(scored).select("row_id", F.round("score", 6).alias("score"), "unusual")


@query("model_suite")
def model_suite(spark, d):
    """All five models on the embeddings' first eight dimensions."""
    dims = 8
    e = t(spark, d, "embeddings").select(*[F.element_at("embedding", i + 1).cast("double").alias(f"x{i}") for i in range(dims)])
    profile = TableProfile("Embeddings", "embeddings", e.count(), [{"name": c, "kind": "numeric"} for c in e.columns])
    return models.model_findings(e, profile).select("type", "title", "value", "n", "method", "details")
