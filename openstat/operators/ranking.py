"""Deduplicate, rank and choose findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from openstat import rules


def is_geo_comparison() -> Column:
    second = F.lower(F.try_element_at("columns", F.lit(2)))
    return (F.col("type") == "group_comparison") & F.coalesce(second.isin(*rules.GEO_COLUMNS), F.lit(False))


def is_primary() -> Column:
    return F.coalesce(F.get_json_object("details", "$.primary") == "true", F.lit(False))


def reweight(findings: DataFrame, compare: bool) -> DataFrame:
    """In compare mode correlations lead, geographic bars and trends step back."""
    if not compare:
        return findings
    factor = (
        F.when(F.col("type") == "spearman_correlation", 2.5)
        .when(is_geo_comparison(), 0.05)
        .when(F.col("type") == "time_trend", 0.6)
        .otherwise(1.0)
    )
    return findings.withColumn("score", F.col("score") * factor)


def rank_findings(findings: DataFrame, limit: int = rules.MAX_STORED_FINDINGS) -> DataFrame:
    """Best score per (type, columns, datasets); then the top `limit`, with position and id.

    Ties are broken by type and columns so that ranks do not depend on task order.
    """
    key = ["type", "__columns", "__datasets"]
    keyed = findings.withColumns({"__columns": F.array_sort("columns"), "__datasets": F.array_sort("datasets")})
    best = W.partitionBy(*key).orderBy(F.desc("score"), "title", "details")
    top = (
        keyed.withColumn("__r", F.row_number().over(best)).where("__r = 1")
        .orderBy(F.desc("score"), *key).limit(limit)
    )
    order = W.orderBy(F.desc("score"), *key)  # at most `limit` rows
    ranked = top.withColumn("rank", F.row_number().over(order)).drop("__r", "__columns", "__datasets")
    return ranked.withColumn("id", F.concat(F.lit("f_"), F.col("rank").cast("string")))


def choose_display(
    ranked: DataFrame, n: int = rules.DISPLAY_TOP, per_type: int = rules.MAX_PER_TYPE, compare: bool = False
) -> DataFrame:
    """Top cards with variety: a lead correlation in compare mode, at most two per type, then backfill.

    Input has `rank` (1 = best). Geographic bars are skipped in compare mode
    unless everything fits.
    """
    lead_order = W.orderBy(F.desc("__corr"), F.desc("__primary"), "rank")
    rows = (
        ranked.withColumn("__corr", F.col("type") == "spearman_correlation")
        .withColumn("__primary", F.col("__corr") & is_primary())
        .withColumn("__lead", F.lit(compare) & F.col("__corr") & (F.row_number().over(lead_order) == 1))
    )
    slots = F.lit(n) - F.max(F.col("__lead").cast("int")).over(W.partitionBy())
    rows = rows.withColumn("__slots", slots).withColumn(
        "__fits", F.count_if(~F.col("__lead")).over(W.partitionBy()) <= F.col("__slots")
    )
    allowed = F.lit(not compare) | ~is_geo_comparison()
    typed = W.partitionBy("type", "__allowed").orderBy(F.desc("__lead"), "rank")
    rows = rows.withColumn("__allowed", allowed).withColumn("__nth", F.row_number().over(typed))
    stage = (
        F.when(F.col("__lead"), 0).when(F.col("__fits"), 1)
        .when(F.col("__allowed") & (F.col("__nth") <= per_type), 1)
        .when(F.col("__allowed"), 2)
    )
    rows = rows.withColumn("__stage", stage).where("__stage is not null")
    order = W.orderBy("__stage", "rank")
    chosen = rows.withColumn("display_order", F.row_number().over(order)).where(F.col("display_order") <= n)
    return chosen.drop(*[c for c in chosen.columns if c.startswith("__")])
