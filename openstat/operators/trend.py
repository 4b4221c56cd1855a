"""Linear trend of measures over time, many (measure, time) plans at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from openstat import rules
from openstat.functions.pvalues import t_pvalue
from openstat.functions.text import column_label
from openstat.functions.times import epoch_seconds
from openstat.operators.scoring import as_findings, empty_findings, evidence_score

PLAN = ["measure", "time"]


def long_form(df: DataFrame, plans: list[tuple[str, str]]) -> DataFrame:
    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("measure"), F.lit(t).alias("time"),
                epoch_seconds(F.col(f"`{t}`")).alias("x"), F.col(f"`{m}`").cast("double").alias("y"),
            )
            for m, t in plans
        ]
    )
    return df.select(F.inline(cells)).where("x is not null and y is not null")


def _fit(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(*PLAN).agg(
        F.count(F.lit(1)).alias(f"{name}_n"), F.regr_slope("y", "x").alias(f"{name}_slope"),
        F.corr("y", "x").alias(f"{name}_r"), (F.min("y") < F.max("y")).alias(f"{name}_varies"),
    )


def trend_stats(df: DataFrame, plans: list[tuple[str, str]], by_time: bool = False) -> DataFrame:
    """(measure, time, n, slope per second, r, aggregated) per plan.

    Repeated times are averaged first, unless at least 90 % of the rows have a
    time of their own. Both fits come from map-side combined aggregates, so no
    plan decides anything on the driver.
    """
    rows = long_form(df, plans)
    times = rows.groupBy(*PLAN, "x").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("c"))
    raw, mean = _fit(rows, "raw"), _fit(times, "mean")
    both = raw.join(mean, PLAN)
    repeated = F.lit(by_time) | (F.col("mean_n") < F.col("raw_n"))
    averaged = repeated & (F.col("mean_n") < 0.9 * F.col("raw_n"))

    def chosen(c: str):
        return F.when(averaged, F.col(f"mean_{c}")).otherwise(F.col(f"raw_{c}")).alias(c)

    return both.where("raw_n >= 12").select(
        *PLAN, chosen("n"), chosen("slope"), chosen("r"), chosen("varies"), repeated.alias("aggregated")
    ).where("n >= 8 and varies").drop("varies")


def trend_findings(
    df: DataFrame, plans: list[tuple[str, str]], resource_id: str, title: str,
    by_time: bool = False, labels: dict[str, str] | None = None,
) -> DataFrame:
    if not plans:
        return empty_findings(df.sparkSession)
    r = F.col("r")
    t = F.when(F.abs(r) >= 1, F.lit(float("inf"))).otherwise(r * F.sqrt((F.col("n") - 2) / (1 - r * r)))
    kept = (
        trend_stats(df, plans, by_time).withColumn("p", t_pvalue(t, (F.col("n") - 2).cast("double")))
        .where(F.col("p") < rules.MAX_P)
    )
    measure = column_label(F.col("measure"))
    for name, text in (labels or {}).items():
        measure = F.when(F.col("measure") == name, F.lit(text)).otherwise(measure)
    direction = F.when(F.col("slope") > 0, "upward").otherwise("downward")
    raw_sql = F.format_string(
        "SELECT `%s`, `%s` FROM data WHERE `%s` IS NOT NULL ORDER BY 1", "time", "measure", "measure"
    )
    mean_sql = F.format_string(
        "SELECT `%s`, AVG(`%s`) AS `%s` FROM data WHERE `%s` IS NOT NULL GROUP BY 1 ORDER BY 1",
        "time", "measure", "measure", "measure",
    )
    return as_findings(
        kept.withColumns({"lm": measure, "direction": direction}),
        type=F.lit("time_trend"),
        title=F.format_string("%s shows an %s trend over time", "lm", "direction"),
        columns=F.array("measure", "time"),
        value=F.round("r", 4), p_value=F.round("p", 6), n=F.col("n"), method=F.lit("linear_trend"),
        caveat=F.lit("trend uses global average by year across countries when data is panel-shaped"),
        sql=F.when(F.col("aggregated"), mean_sql).otherwise(raw_sql),
        datasets=F.array(F.lit(resource_id)),
        score=evidence_score(F.col("slope"), F.col("p")),
        details=F.to_json(
            F.struct(
                F.lit(title).alias("dataset_title"), "direction", "aggregated",
                F.create_map("measure", "lm").alias("column_labels"),
            )
        ),
    )
