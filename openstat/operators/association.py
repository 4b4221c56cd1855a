"""Category association: crosstab, chi-square and Cramér's V."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from openstat import rules
from openstat.functions.pvalues import chi2_pvalue
from openstat.functions.text import column_label
from openstat.operators.scoring import as_findings, evidence_score


def crosstab(df: DataFrame, a: str, b: str, max_levels: int = 20) -> DataFrame:
    """(level_a, level_b, n) for every combination, zero where none occurs.

    A column with more than `max_levels` levels yields no table, so the grid of
    combinations stays small by rule.
    """
    cells = (
        df.select(F.col(f"`{a}`").cast("string").alias("level_a"), F.col(f"`{b}`").cast("string").alias("level_b"))
        .dropna().groupBy("level_a", "level_b").agg(F.count(F.lit(1)).alias("n"))
    )
    levels = cells.agg(F.greatest(F.countDistinct("level_a"), F.countDistinct("level_b")))
    cells = cells.where(levels.scalar() <= max_levels)
    others = cells.agg(F.collect_set("level_b")).scalar()
    grid = (
        cells.select("level_a").distinct().withColumn("others", others)
        .select("level_a", F.explode("others").alias("level_b"))
    )
    return grid.join(cells, ["level_a", "level_b"], "left").na.fill(0, ["n"])


def chi_square(table: DataFrame) -> DataFrame:
    """One row: chi2 (Yates when df = 1), df, n, rows, cols, smallest cell, Cramér's V."""
    cells = table.select(
        "n",
        F.sum("n").over(W.partitionBy("level_a")).alias("row_total"),
        F.sum("n").over(W.partitionBy("level_b")).alias("col_total"),
        F.row_number().over(W.partitionBy("level_a").orderBy("level_b")).alias("ra"),
        F.row_number().over(W.partitionBy("level_b").orderBy("level_a")).alias("rb"),
    ).withColumn("total", table.agg(F.sum("n")).scalar())
    shape = cells.agg(F.max("rb").alias("r"), F.max("ra").alias("k"))
    cells = cells.withColumn("r", shape.select("r").scalar()).withColumn("k", shape.select("k").scalar())
    expected = F.col("row_total") * F.col("col_total") / F.col("total")
    gap = F.abs(F.col("n") - expected)
    df = (F.col("r") - 1) * (F.col("k") - 1)
    corrected = F.when(df == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    one = cells.groupBy("r", "k", "total").agg(
        F.sum(F.try_divide(corrected * corrected, expected)).alias("chi2"), F.min("n").alias("min_cell")
    )
    smaller = F.least(F.col("r") - 1, F.col("k") - 1)
    return one.select(
        "chi2", df.cast("bigint").alias("df"), F.col("total").cast("bigint").alias("n"),
        F.col("r").alias("n_rows"), F.col("k").alias("n_cols"), "min_cell",
        F.when(smaller > 0, F.sqrt(F.col("chi2") / (F.col("total") * smaller))).otherwise(0.0).alias("cramers_v"),
    )


def chi_square_findings(df: DataFrame, a: str, b: str, resource_id: str, title: str) -> DataFrame:
    """Association with n >= 20, at most 20 levels a side, every cell >= 5, p < .05."""
    tested = chi_square(crosstab(df, a, b)).where(
        (F.col("n") >= 20) & (F.col("min_cell") >= rules.MIN_CELL) & (F.col("df") > 0)
    )
    kept = tested.withColumn("p", chi2_pvalue(F.col("chi2"), F.col("df").cast("double"))).where(
        F.col("p") < rules.MAX_P
    )

    def label(c: str) -> Column:
        return column_label(F.lit(c))

    return as_findings(
        kept,
        type=F.lit("chi_square"),
        title=F.concat_ws(" ", label(a), F.lit("and"), label(b), F.lit("appear linked")),
        columns=F.array(F.lit(a), F.lit(b)),
        value=F.round("cramers_v", 4), p_value=F.round("p", 6), n=F.col("n"),
        method=F.lit("chi_square"),
        caveat=F.lit("association in categories does not imply causation"),
        sql=F.lit(f"SELECT `{a}`, `{b}`, COUNT(*) AS n FROM data GROUP BY 1, 2 ORDER BY 3 DESC"),
        datasets=F.array(F.lit(resource_id)),
        score=evidence_score(F.col("cramers_v"), F.col("p")),
        details=F.to_json(F.struct(F.lit(title).alias("dataset_title"))),
    )
