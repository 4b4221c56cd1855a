"""Group comparison: means, Welch t and Kruskal-Wallis for many column pairs at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from openstat import rules
from openstat.functions.pvalues import chi2_pvalue, t_pvalue
from openstat.functions.text import column_label
from openstat.operators.scoring import as_findings, empty_findings, evidence_score
from openstat.session import cut_lineage

PLAN = ["measure", "factor"]
#: rows planned for a range of values, most ranges of a plan
RANGE_ROWS, _MAX_RANGES = 250_000, 4_096


def long_form(df: DataFrame, plans: list[tuple[str, str]]) -> DataFrame:
    """(measure, factor, level, value): one row per plan where both are non-null."""
    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("measure"), F.lit(g).alias("factor"),
                F.col(f"`{g}`").cast("string").alias("level"),
                F.col(f"`{m}`").cast("double").alias("value"),
            )
            for m, g in plans
        ]
    )
    return df.select(F.inline(cells)).where("level is not null and value is not null")


def group_moments(rows: DataFrame) -> DataFrame:
    """Count, mean and variance of the twelve largest levels of a plan; `n_all` counts the rows of all.

    Spark limits the rank within each task first, so a plan of many levels is not ordered in one.
    """
    grouped = rows.groupBy(*PLAN, "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
        F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("var_pop"),
    )
    by_size = W.partitionBy(*PLAN).orderBy(F.desc("n"), "level")
    largest = grouped.withColumn("size_rank", F.row_number().over(by_size)).where(F.col("size_rank") <= rules.MAX_GROUPS)
    totals = grouped.groupBy(*PLAN).agg(F.sum("n").alias("n_all"))
    return largest.join(totals, PLAN).withColumn("tested", F.col("n") >= rules.MIN_GROUP_SIZE)


def group_means(df: DataFrame, measure: str, factor: str) -> DataFrame:
    """Mean per level for the twelve largest levels with at least three rows."""
    return group_moments(long_form(df, [(measure, factor)])).where("tested").select("level", "n", "mean")


def _spread(moments: DataFrame) -> DataFrame:
    """Per plan: rows and sample deviation over the largest levels, means and their range over the tested."""
    n, w = F.col("n"), W.partitionBy(*PLAN)
    centered = moments.withColumn("grand", F.sum(n * F.col("mean")).over(w) / F.sum(n).over(w))
    within = n * F.col("var_pop")
    between = n * (F.col("mean") - F.col("grand")) ** 2
    t = F.col("tested")
    sample_var = F.col("var_pop") * F.col("n") / (F.col("n") - 1)
    share = F.when(t, sample_var / F.col("n"))
    first = F.min_by("mean", F.when(t, F.col("level")))
    last = F.max_by("mean", F.when(t, F.col("level")))
    return centered.groupBy(*PLAN).agg(
        F.max("n_all").alias("n_all"), F.sum("n").alias("n"),
        F.sqrt(F.sum(within + between) / (F.sum("n") - 1)).alias("std"),
        F.count_if(t).alias("groups"),
        F.sum(F.when(t, F.col("n"))).alias("n_tested"),
        (F.max(F.when(t, F.col("mean"))) - F.min(F.when(t, F.col("mean")))).alias("effect"),
        F.max_by("level", F.when(t, F.col("mean"))).alias("highest_group"),
        F.min_by("level", F.when(t, F.col("mean"))).alias("lowest_group"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(t, F.struct("level", "mean"))))
        ).alias("group_means"),
        (first - last).alias("difference"),
        F.sum(share).alias("error2"),
        F.sum(F.when(t, share * share / (F.col("n") - 1))).alias("error4"),
    )


def _welch_statistic() -> tuple[Column, Column]:
    t = F.try_divide("difference", F.sqrt("error2"))
    return t, F.try_divide(F.col("error2") * F.col("error2"), F.col("error4"))


def welch(moments: DataFrame) -> DataFrame:
    """t and df for plans with exactly two tested levels, first level minus last in name order."""
    t, df = _welch_statistic()
    return _spread(moments).where("groups = 2").select(
        *PLAN, F.lit("welch_t").alias("method"), t.alias("statistic"), df.alias("df")
    )


def _in_ranges(cells: DataFrame, n_rows: int) -> DataFrame:
    """Adds `range`, the number of the value's range within its plan; the ranges hold about RANGE_ROWS rows.

    Bounds come from a sample of the rows. They only share out the work: any bounds give the same ranks.
    """
    cuts = min(_MAX_RANGES, -(-n_rows // RANGE_ROWS))
    if cuts <= 1:
        return cells.withColumn("range", F.lit(0))
    sampled = cells.sample(min(1.0, 200 * cuts / n_rows), 42)
    shares = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    bounds = sampled.groupBy("plan").agg(F.percentile_approx("value", shares, F.lit(4 * max(cuts, 2_500))).alias("__bounds"))
    step = math.isqrt(cuts) + 1  # every step-th bound first, then the bounds behind it
    bounds = bounds.withColumn("__coarse", F.filter("__bounds", lambda b, i: i % step == step - 1))
    block = F.size(F.filter("__coarse", lambda b: b < F.col("value"))) * step
    fine = F.size(F.filter(F.slice("__bounds", F.col("__block") + 1, F.lit(step)), lambda b: b < F.col("value")))
    return (
        cells.join(F.broadcast(bounds), "plan", "left")  # one row per plan
        .withColumn("__block", F.coalesce(F.when(F.col("__bounds").isNotNull(), block), F.lit(0)))
        .withColumn("range", F.coalesce(F.when(F.col("__bounds").isNotNull(), F.col("__block") + fine), F.lit(0)))
        .drop("__bounds", "__coarse", "__block")
    )


def kruskal(rows: DataFrame, moments: DataFrame) -> DataFrame:
    """Tie-corrected H for plans with 3 to 12 tested levels.

    Plans and levels go by number (at most 12 per plan, held by the driver). Rows are counted per
    (level, value), cut into ranges of values and ranked within a range; a range returns a rank sum per
    level, to which the rows of the ranges before it are added.
    """
    tested: dict[tuple[str, str], list] = {}
    for r in moments.where("tested").select(*PLAN, "level", "n").orderBy(*PLAN, "level").collect():
        tested.setdefault((r["measure"], r["factor"]), []).append((r["level"], r["n"]))
    plans = [(p, levels) for p, levels in tested.items() if len(levels) >= 3]
    spark, schema = rows.sparkSession, "measure string, factor string, level string, plan int, at int"
    numbers = spark.createDataFrame(
        [(*p, level, i, j) for i, (p, levels) in enumerate(plans) for j, (level, _) in enumerate(levels)], schema
    )
    named = spark.createDataFrame([(i, *p, len(levels)) for i, (p, levels) in enumerate(plans)], "plan int, measure string, factor string, groups int")
    cells = rows.join(F.broadcast(numbers), [*PLAN, "level"]).select("plan", "at", "value")
    placed = _in_ranges(cells, max((sum(n for _, n in levels) for _, levels in plans), default=0))
    counted = placed.groupBy("plan", "range", "at", "value").agg(F.count(F.lit(1)).alias("c"))
    by_value = W.partitionBy("plan", "range").orderBy("value")
    tied = F.sum("c").over(by_value.rangeBetween(W.currentRow, W.currentRow))
    upto = F.sum("c").over(by_value.rangeBetween(W.unboundedPreceding, W.currentRow))
    c, tie = F.col("c"), F.col("tied").cast("double")
    ranges = cut_lineage(
        counted.select("plan", "range", "at", "c", tied.alias("tied"), upto.alias("upto")).groupBy("plan", "range", "at").agg(
            F.sum("c").alias("c"), F.sum(c * (F.col("upto") - (F.col("tied") - 1) / 2.0)).alias("s"), F.sum(c * (tie * tie - 1.0)).alias("tie")
        )
    )  # at most twelve rows per range
    earlier = W.partitionBy("plan").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.groupBy("plan", "range").agg(F.sum("c").alias("rows")).select(
        "plan", "range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before")
    )
    sums = ranges.join(F.broadcast(offsets), ["plan", "range"]).groupBy("plan", "at").agg(
        F.sum("c").alias("c"), F.sum(F.col("s") + F.col("before") * F.col("c")).alias("s"), F.sum("tie").alias("tie")
    )
    h = sums.groupBy("plan").agg(
        F.sum("c").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("c")).alias("q"), F.sum("tie").alias("tie")
    )
    n = F.col("n").cast("double")
    raw = 12.0 / (n * (n + 1)) * F.col("q") - 3.0 * (n + 1)
    return h.join(F.broadcast(named), "plan").select(  # one row per plan
        *PLAN, F.lit("kruskal").alias("method"),
        F.try_divide(raw, 1.0 - F.col("tie") / (n * n * n - n)).alias("statistic"),
        (F.col("groups") - 1).cast("double").alias("df"),
    )


def normalized_effect(effect: Column, std: Column) -> Column:
    return F.when(std > 0, F.least(F.lit(1.0), effect / (4.0 * std))).otherwise(0.0)


def group_tests(df: DataFrame, plans: list[tuple[str, str]]) -> DataFrame:
    """One row per plan: method, statistic, df, p, effect, normalized effect, n, means."""
    rows = long_form(df, plans)
    moments = cut_lineage(group_moments(rows))  # at most twelve rows per plan
    t, welch_df = _welch_statistic()
    two = F.col("groups") == 2
    spread = _spread(moments).withColumns(
        {"w_statistic": F.when(two, t), "w_df": F.when(two, welch_df)}
    )
    many = moments.where("tested").groupBy(*PLAN).agg(F.count(F.lit(1)).alias("g")).where("g >= 3")
    if many.limit(1).count():
        ranked = kruskal(rows, moments).select(*PLAN, F.col("statistic").alias("h"), F.col("df").alias("h_df"))
        spread = spread.join(F.broadcast(ranked), PLAN, "left")  # one row per plan
    else:
        spread = spread.withColumns({"h": F.lit(None).cast("double"), "h_df": F.lit(None).cast("double")})
    p = F.when(two, t_pvalue(F.col("statistic"), F.col("df"))).otherwise(chi2_pvalue(F.col("statistic"), F.col("df")))
    return (
        spread.where("n_all >= 12 and groups >= 2")
        .withColumns(
            {
                "method": F.when(two, "welch_t").otherwise("kruskal"),
                "statistic": F.coalesce("w_statistic", "h"), "df": F.coalesce("w_df", "h_df"),
            }
        )
        .where("statistic is not null")
        .withColumn("p", p)
        .withColumn("normalized", normalized_effect(F.col("effect"), F.col("std")))
        .drop("w_statistic", "w_df", "h", "h_df")
    )


def group_findings(
    df: DataFrame, plans: list[tuple[str, str]], resource_id: str, title: str,
    labels: dict[str, str] | None = None,
) -> DataFrame:
    if not plans:
        return empty_findings(df.sparkSession)
    kept = group_tests(df, plans).where(F.col("p") < rules.MAX_P)
    measure = column_label(F.col("measure"))
    for name, text in (labels or {}).items():
        measure = F.when(F.col("measure") == name, F.lit(text)).otherwise(measure)
    return as_findings(
        kept.withColumns({"lm": measure, "lg": column_label(F.col("factor"))}),
        type=F.lit("group_comparison"),
        title=F.concat_ws(" ", "lm", F.lit("differs across"), "lg"),
        columns=F.array("measure", "factor"),
        value=F.round("effect", 4), p_value=F.round("p", 6), n=F.col("n"), method=F.col("method"),
        caveat=F.lit("group differences may reflect confounding"),
        sql=F.format_string(
            "SELECT `%s`, AVG(`%s`) AS mean_value FROM data GROUP BY 1 ORDER BY 2 DESC", "factor", "measure"
        ),
        datasets=F.array(F.lit(resource_id)),
        score=evidence_score(F.least(F.lit(1.0), F.col("normalized")), F.col("p")),
        details=F.to_json(
            F.struct(
                F.lit(title).alias("dataset_title"), "group_means", "highest_group", "lowest_group",
                F.create_map("measure", "lm", "factor", "lg").alias("column_labels"),
            )
        ),
    )
