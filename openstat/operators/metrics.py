"""Usage metrics over visit and run logs.

Distinct visitors are counted by grouping to (key, visitor) first, so a visitor
or path that holds most of the rows is combined before the shuffle and no task
holds a set of visitors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from openstat import rules
from openstat.functions.text import literal_map
from openstat.functions.times import LOCAL_ZONE, local_day
from openstat.operators.ranks import quantiles

# --- visits: visitor_id, path, created_at ------------------------------------------


def visitor_totals(visits: DataFrame, cutoff: Column) -> DataFrame:
    """All-time and window page views and visitors, and when tracking began."""
    recent = F.col("created_at") >= cutoff
    per_visitor = visits.groupBy("visitor_id").agg(
        F.count(F.lit(1)).alias("views"), F.min("created_at").alias("first"), F.count_if(recent).alias("recent")
    )
    return per_visitor.agg(
        F.min("first").alias("tracking_since"),
        F.coalesce(F.sum("views"), F.lit(0)).alias("total_page_views"),
        F.count("visitor_id").alias("unique_visitors_all_time"),
        F.coalesce(F.sum("recent"), F.lit(0)).alias("page_views_in_window"),
        F.count_if((F.col("recent") > 0) & F.col("visitor_id").isNotNull()).alias("unique_visitors_in_window"),
    )


def visitors_with_analysis(sessions: DataFrame, cutoff: Column) -> DataFrame:
    return (
        sessions.where((F.col("created_at") >= cutoff) & F.col("visitor_id").isNotNull())
        .agg(F.countDistinct("visitor_id").alias("unique_visitors_with_analysis"))
    )


def _visitors_by(visits: DataFrame, key: Column, name: str) -> DataFrame:
    pairs = visits.groupBy(key.alias(name), "visitor_id").agg(F.count(F.lit(1)).alias("views"))
    return pairs.groupBy(name).agg(F.count("visitor_id").alias("visitors"), F.sum("views").alias("page_views"))


def daily_visitors(visits: DataFrame, cutoff: Column, zone: str = LOCAL_ZONE) -> DataFrame:
    """Distinct visitors and views per local day."""
    recent = visits.where(F.col("created_at") >= cutoff)
    day = F.date_format(local_day(F.col("created_at"), zone), "yyyy-MM-dd")
    return _visitors_by(recent, day, "day").orderBy("day")


def top_paths(visits: DataFrame, cutoff: Column, n: int = 10) -> DataFrame:
    recent = visits.where(F.col("created_at") >= cutoff)
    return (
        _visitors_by(recent, F.col("path"), "path").withColumnRenamed("page_views", "views")
        .orderBy(F.desc("views"), "path").limit(n)
    )


# --- runs: id, status, created_at, updated_at, resource_ids, user_intent, error ------


def with_duration(runs: DataFrame) -> DataFrame:
    seconds = (F.unix_micros(F.col("updated_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6
    return runs.withColumn("duration_sec", seconds)


def newest_runs(runs: DataFrame, n: int | None) -> DataFrame:
    """The newest n runs, or all of them."""
    return runs if n is None else runs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def duration_stats(runs: DataFrame, column: str = "duration_sec", by: list[str] | None = None) -> DataFrame:
    """count, mean, median, p90 (linear interpolation), max and min, one decimal."""
    by = by or []
    plain = runs.where(F.col(column).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.round(F.avg(column), 1).alias("mean_sec"),
        F.round(F.max(column), 1).alias("max_sec"), F.round(F.min(column), 1).alias("min_sec"),
    )
    marks = quantiles(runs, column, {"median": 0.5, "p90": 0.9}, by)
    rounded = marks.select(*by, F.round("median", 1).alias("median_sec"), F.round("p90", 1).alias("p90_sec"))
    if by:
        return plain.join(rounded, by)
    return plain.withColumn("median_sec", rounded.select("median_sec").scalar()).withColumn(
        "p90_sec", rounded.select("p90_sec").scalar()
    )


def run_counts(runs: DataFrame, cutoff: Column) -> DataFrame:
    """Runs by status, with how many had an intent, two or more datasets, or fall in the window."""
    return runs.groupBy("status").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.trim(F.coalesce("user_intent", F.lit(""))) != "").alias("with_user_intent"),
        F.count_if(F.size("resource_ids") >= 2).alias("two_dataset_runs"),
        F.count_if(F.col("created_at") >= cutoff).alias("recent_in_window"),
    )


def daily_runs(runs: DataFrame, cutoff: Column) -> DataFrame:
    """Runs per UTC day."""
    return (
        runs.where(F.col("created_at") >= cutoff)
        .groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"))
        .agg(F.count(F.lit(1)).alias("runs")).orderBy("day")
    )


def top_datasets(runs: DataFrame, catalog: DataFrame, cutoff: Column, n: int = 20) -> DataFrame:
    """Most used datasets with title and portal; unknown ids keep their id as title."""
    used = (
        runs.where(F.col("created_at") >= cutoff).select(F.explode("resource_ids").alias("resource_id"))
        .groupBy("resource_id").agg(F.count(F.lit(1)).alias("uses"))
        .orderBy(F.desc("uses"), "resource_id").limit(n)
    )
    meta = catalog.select(F.col("id").alias("resource_id"), "title", "portal")
    return used.join(meta, "resource_id", "left").select(
        "resource_id", F.coalesce("title", F.col("resource_id").cast("string")).alias("title"),
        F.coalesce("portal", F.lit("unknown")).alias("portal"), "uses",
    )


def failure_reasons(runs: DataFrame, n: int = 8, width: int = 120) -> DataFrame:
    failed = runs.where((F.col("status") == "failed") & (F.coalesce("error", F.lit("")) != ""))
    return (
        failed.groupBy(F.left("error", F.lit(width)).alias("reason")).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "reason").limit(n)
    )


def in_range(runs: DataFrame, preset: str, first: str | None = None, last: str | None = None,
             zone: str = LOCAL_ZONE) -> DataFrame:
    """Runs whose local day is in the last 7 or 30 days of the data, a given range, or any day."""
    dated = runs.withColumn("day", F.date_format(local_day(F.col("created_at"), zone), "yyyy-MM-dd"))
    if preset in ("7d", "30d"):
        newest = dated.agg(F.date_format(F.date_sub(F.max("day").cast("date"), int(preset[:-1]) - 1), "yyyy-MM-dd"))
        return dated.where(F.col("day") >= newest.scalar())
    if preset == "custom" and first and last:
        low, high = sorted((first, last))
        return dated.where(F.col("day").between(low, high))
    return dated


def range_dashboard(runs: DataFrame) -> DataFrame:
    """(section, label, value) rows of the date-range dashboard for runs from `in_range`."""
    timed = with_duration(runs)

    def section(name: str, rows: DataFrame, label, value) -> DataFrame:
        return rows.select(F.lit(name).alias("section"), label.cast("string").alias("label"), value.cast("double").alias("value"))

    status = timed.groupBy("status").agg(F.count(F.lit(1)).alias("c"))
    per_day = timed.groupBy("day").agg(F.count(F.lit(1)).alias("c"))
    one = timed.agg(F.count(F.lit(1)).alias("count"), F.count_if(F.size("resource_ids") >= 2).alias("two_dataset"))
    stats = duration_stats(timed)
    complete = duration_stats(timed.where("status = 'complete'"))
    names = ("count", "mean_sec", "median_sec", "p90_sec", "max_sec", "min_sec")

    def spread(rows: DataFrame) -> DataFrame:
        return rows.select(F.inline(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in names])))

    return reduce(
        DataFrame.unionByName,
        [
            section("status", status, F.col("status"), F.col("c")),
            section("day", per_day, F.col("day"), F.col("c")),
            section("total", one, F.lit("count"), F.col("count")),
            section("total", one, F.lit("two_dataset"), F.col("two_dataset")),
            section("duration_all", spread(stats), F.col("m"), F.col("v")),
            section("duration_complete", spread(complete), F.col("m"), F.col("v")),
            section("failure", failure_reasons(timed, 6), F.col("reason"), F.col("count")),
        ],
    )


def run_snapshot(runs: DataFrame, n: int = 50) -> DataFrame:
    """Newest n runs with duration, dataset count and how many of them share the status."""
    newest = with_duration(newest_runs(runs, n))
    return newest.select(
        "id", "status", F.size("resource_ids").alias("resource_count"), "duration_sec", "error",
        F.count(F.lit(1)).over(W.partitionBy("status")).alias("status_total"),  # n rows
    )


# --- stale runs -----------------------------------------------------------------------


def stale_after_minutes(large: Column) -> Column:
    return F.when(F.coalesce(large, F.lit(False)), rules.STALE_MINUTES_LARGE).otherwise(rules.STALE_MINUTES)


def stale_message(status: Column, phase: Column, large: Column) -> Column:
    downloading = (status == "ingesting") | (phase == "ingest")
    return (
        F.when(downloading & F.coalesce(large, F.lit(False)), rules.STALE_LARGE_DOWNLOAD)
        .when(downloading, rules.STALE_DOWNLOAD)
        .otherwise(rules.STALE_ANALYSIS)
    )


def recover_stale(runs: DataFrame, now: Column) -> DataFrame:
    """Active runs without a heartbeat for too long become failed, with a reason."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))
    limit = stale_after_minutes(F.col("large")).cast("bigint") * F.lit(60_000_000).cast("bigint")
    stale = F.coalesce(F.col("status").isin(*rules.ACTIVE_STATES) & (age > limit), F.lit(False))
    message = stale_message(F.col("status"), F.col("phase"), F.col("large"))
    return runs.withColumns(
        {
            "error": F.when(stale, message).otherwise(F.col("error")),
            "phase": F.when(stale, "failed").otherwise(F.col("phase")),
            "status": F.when(stale, "failed").otherwise(F.col("status")),
            "recovered": stale,
        }
    )


# --- catalog and usage -----------------------------------------------------------------


def catalog_health(catalog: DataFrame, top: int = 10) -> DataFrame:
    """(section, label, total, ingestible, blocked): by portal, overall, and top block reasons."""
    ok = F.coalesce(F.col("ingestible"), F.lit(False))
    by_portal = catalog.groupBy("portal").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("ingestible"), F.count_if(~ok).alias("blocked")
    )
    overall = by_portal.agg(F.sum("total").alias("total"), F.sum("ingestible").alias("ingestible"), F.sum("blocked").alias("blocked"))
    reasons = (
        catalog.where(~ok).groupBy(F.coalesce("ingest_block_reason", F.lit("unknown")).alias("label"))
        .agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "label").limit(top)
    )
    return reduce(
        DataFrame.unionByName,
        [
            by_portal.select(F.lit("portal").alias("section"), F.col("portal").alias("label"), "total", "ingestible", "blocked"),
            overall.select(F.lit("all").alias("section"), F.lit("all").alias("label"), "total", "ingestible", "blocked"),
            reasons.select(F.lit("reason").alias("section"), "label", "total", F.lit(0).cast("bigint").alias("ingestible"), F.col("total").alias("blocked")),
        ],
    )


def usage_ledger(calls: DataFrame) -> DataFrame:
    """Tokens, cost and calls per UTC month. Calls without tokens do not count."""
    def price(i: int) -> Column:
        known = literal_map({m: p[i] for m, p in rules.MODEL_PRICES.items()})
        return F.coalesce(F.element_at(known, F.col("model")), F.lit(rules.DEFAULT_PRICE[i]))

    tin, tout = F.coalesce("tokens_in", F.lit(0)), F.coalesce("tokens_out", F.lit(0))
    cost = tin / 1_000_000 * price(0) + tout / 1_000_000 * price(1)
    return calls.where((tin != 0) | (tout != 0)).groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        F.sum(tin).alias("tokens_in"), F.sum(tout).alias("tokens_out"), F.sum(cost).alias("cost_usd"),
        F.count(F.lit(1)).alias("calls"),
    )


def budget_state(ledger: DataFrame, budget: float = rules.BUDGET_USD) -> DataFrame:
    """Ledger months with whether the budget is used up; a budget of zero or less never is."""
    over = F.lit(budget > 0) & (F.col("cost_usd") >= F.lit(float(budget)))
    return ledger.withColumn("over_budget", over)


def is_large_download(portal: Column, hint: Column) -> Column:
    rows = F.coalesce(hint, F.lit(0))
    return ((portal == "nyc_open_data") & (rows >= rules.LARGE_ROW_HINT)) | (rows >= rules.ROW_CAP)
