"""Ranks and exact quantiles without a single-task sort.

Equal values are grouped first, so a value that holds a large share of the rows
is one row. A short list of distinct values is ranked by one window per domain.
A long one is cut into ranges by approximate quantiles; a small table of range
totals gives each range its offset, and the running count is a window inside a
range. No window then holds more than a range, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from openstat.session import cut_lineage

#: distinct values one window may hold
RANGE_ROWS = 500_000
_MAX_RANGES = 4096
_STEP = 64


def rows_before(
    counts: DataFrame, domain: list[str], value: str = "value", n: str = "n", settled: bool = False,
    range_rows: int | None = None,
) -> DataFrame:
    """Adds `before`, the rows with a smaller value in the same domain.

    `counts` holds one row per (domain, value) with its number of rows; the number
    of domains must be small (one per test and side, or one per report group).
    The counts are read several times and their values are joined on, so they are
    written once first, unless they are `settled` already.
    """
    if not settled:
        counts = cut_lineage(counts)
    cuts = min(_MAX_RANGES, -(-counts.count() // (range_rows or RANGE_ROWS)))
    if cuts <= 1:
        smaller = W.partitionBy(*domain).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        return counts.withColumn("before", F.coalesce(F.sum(n).over(smaller), F.lit(0)))
    probabilities = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    bounds = counts.groupBy(*domain).agg(
        F.percentile_approx(value, probabilities, F.lit(4 * max(cuts, 2_500))).alias("__bounds")
    ).withColumn("__coarse", F.filter("__bounds", lambda b, i: i % _STEP == _STEP - 1))
    if domain:
        bounded = counts.join(F.broadcast(bounds), domain)  # one row per domain
    else:
        bounded = counts.withColumn("__bounds", bounds.select("__bounds").scalar()).withColumn(
            "__coarse", bounds.select("__coarse").scalar()
        )
    # every 64th bound first, then the 64 bounds behind it
    block = F.size(F.filter("__coarse", lambda b: b < F.col(value))) * _STEP
    placed = (
        bounded.withColumn("__block", block)
        .withColumn(
            "__range",
            F.col("__block")
            + F.size(F.filter(F.slice("__bounds", F.col("__block") + 1, F.lit(_STEP)), lambda b: b < F.col(value))),
        )
        .drop("__bounds", "__coarse", "__block")
    )
    totals = placed.groupBy(*domain, "__range").agg(F.sum(n).alias("__rows"))
    earlier = W.partitionBy(*domain).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *domain, "__range", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before")
    )
    inside = W.partitionBy(*domain, "__range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return (
        placed.join(F.broadcast(offsets), [*domain, "__range"])  # at most `cuts` rows per domain
        .withColumn("before", F.col("__before") + F.coalesce(F.sum(n).over(inside), F.lit(0)))
        .drop("__range", "__before")
    )


def average_ranks(counts: DataFrame, domain: list[str], value: str = "value", n: str = "n") -> DataFrame:
    """Adds `rank`, the mean rank of the rows that hold a value, within each domain."""
    ranked = rows_before(counts, domain, value, n)
    return ranked.withColumn("rank", F.col("before") + (F.col(n) + 1) / 2.0).drop("before")


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per named share.

    Spark's `percentile` merges every distinct value of a group in one task; this
    reads the two neighboring order statistics off the running counts instead.
    """
    by = by or []
    rows = df.select(*by, F.col(value).cast("double").alias("value")).where("value is not null")
    counts = cut_lineage(rows.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n")))
    placed = rows_before(counts, by, settled=True)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("__total"))
    if by:
        placed = placed.join(F.broadcast(totals), by)  # one row per group
    else:
        placed = placed.withColumn("__total", totals.scalar())
    aggs = []
    for i, share in enumerate(shares.values()):
        at = (F.col("__total") - 1) * F.lit(float(share))
        for edge, position in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("before") <= position) & (position < F.col("before") + F.col("n"))
            aggs.append(F.max(F.when(here, F.col("value"))).alias(f"{edge}{i}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"w{i}"))
    picked = placed.groupBy(*by).agg(*aggs)
    return picked.select(
        *by,
        *[
            (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}")).alias(name)
            for i, name in enumerate(shares)
        ],
    )
