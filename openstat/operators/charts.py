"""Rows behind the charts and the choice of charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from openstat import rules


def scatter_rows(df: DataFrame, x: str, y: str, limit: int = 1500) -> DataFrame:
    """Points with both coordinates; the same rows every time (smallest hash of the pair)."""
    points = df.select(F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y")).dropna()
    return points.orderBy(F.xxhash64("x", "y"), "x", "y").limit(limit)


def line_rows(df: DataFrame, time: str, measure: str, averaged: bool) -> DataFrame:
    """Mean per time, or the rows themselves, in time order; all of them."""
    rows = df.select(F.col(f"`{time}`").alias("time"), F.col(f"`{measure}`").alias("value")).where("value is not null")
    if averaged:
        rows = rows.groupBy("time").agg(F.avg("value").alias("value"))
    return rows.orderBy("time", "value")


def bar_rows(df: DataFrame, measure: str, factor: str, top: int = 10) -> DataFrame:
    """Highest group means, with how many groups there are and the title suffix."""
    means = df.groupBy(F.col(f"`{factor}`").alias("level")).agg(F.avg(f"`{measure}`").alias("mean_value"))
    total = means.agg(F.count(F.lit(1))).scalar()
    placed = means.orderBy(F.desc("mean_value"), "level").limit(top).withColumn("total", total)
    suffix = F.when(F.col("total") > top, F.format_string(f" (top {top} of %d)", "total")).otherwise("")
    return placed.select("level", "mean_value", "total", suffix.alias("title_suffix"))


def choose_charts(display: DataFrame, joined: bool = False, n: int = 6) -> DataFrame:
    """At most six findings to draw: a joined correlation first; code bars give way to name bars."""
    is_joined = F.exists("datasets", lambda d: d.contains("+"))
    any_joined = F.bool_or("__joined").over(W.partitionBy())
    scatter = F.col("__joined") & (F.col("type") == "spearman_correlation")
    rows = display.withColumn("__joined", is_joined).withColumn("__prefer", F.lit(joined) & any_joined)
    first = W.orderBy(F.desc(scatter), "display_order")  # display findings only
    rows = rows.withColumn("__lead", F.col("__prefer") & scatter & (F.row_number().over(first) == 1))
    stage = F.when(F.col("__lead"), 0).when(F.col("__prefer") & F.col("__joined"), 1).otherwise(2)
    order = W.orderBy(stage, "display_order")
    rows = rows.withColumn("chart_order", F.row_number().over(order)).where(F.col("chart_order") <= n)

    second = F.lower(F.try_element_at("columns", F.lit(2)))
    named = F.max(F.when(F.size("columns") == 2, second.isin(*rules.GEO_NAME_FIELDS).cast("int"))).over(
        W.partitionBy(F.try_element_at("columns", F.lit(1)))
    )
    code_bar = (
        F.col("type").isin("group_comparison", "descriptive") & (F.size("columns") == 2)
        & second.isin(*rules.GEO_CODE_FIELDS) & (F.coalesce(named, F.lit(0)) == 1)
    )
    shape: Column = (
        F.when((F.col("type") == "spearman_correlation") & (F.size("columns") == 2), "scatter")
        .when((F.col("type") == "group_comparison") & (F.size("columns") == 2), "bar")
        .when((F.col("type") == "time_trend") & (F.size("columns") == 2), "line")
        .when(
            (F.col("type") == "descriptive") & (F.size("columns") == 2),
            F.when(F.get_json_object("details", "$.chart_type") == "time_trend", "line").when(
                F.get_json_object("details", "$.chart_type") == "group_comparison", "bar"
            ),
        )
    )
    return (
        rows.withColumn("__skip", code_bar).withColumn("chart_type", shape)
        .where("not __skip and chart_type is not null")
        .drop("__joined", "__prefer", "__lead", "__skip")
    )
