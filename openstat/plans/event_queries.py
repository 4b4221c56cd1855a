"""Registered queries: usage metrics over the event log and over orders read as runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from openstat import rules
from openstat.functions import text, times
from openstat.operators import metrics
from openstat.plans.registry import query
from openstat.session import read_table as t


def visits(spark, d):
    e = t(spark, d, "events")
    return e.select(
        F.col("user_id").cast("string").alias("visitor_id"), F.concat(F.lit("/"), "event_type").alias("path"),
        F.col("ts").alias("created_at"), "event_type", "value",
    )


def _cutoff(df, days):
    """Days before the newest row: the log's own clock."""
    newest = df.agg(F.max("created_at"))
    return newest.scalar() - F.make_dt_interval(F.lit(days))


_VISITS = "SELECT user_id::VARCHAR AS visitor_id, '/' || event_type AS path, ts AS created_at, event_type, value FROM events"
_RECENT = f"SELECT * FROM ({_VISITS}) WHERE created_at >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY"


@query(
    "visitor_totals",
    f"""SELECT strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS tracking_since, count(*) AS total_page_views, count(DISTINCT visitor_id) AS unique_visitors_all_time,
               (SELECT count(*) FROM ({_RECENT})) AS page_views_in_window, (SELECT count(DISTINCT visitor_id) FROM ({_RECENT})) AS unique_visitors_in_window FROM ({_VISITS})""",
)
def visitor_totals(spark, d):
    v = visits(spark, d)
    return metrics.visitor_totals(v, _cutoff(v, 10)).withColumn(
        "tracking_since", F.date_format("tracking_since", "yyyy-MM-dd HH:mm:ss")
    )


@query(
    "visitors_with_analysis",
    f"SELECT count(DISTINCT visitor_id) AS unique_visitors_with_analysis FROM ({_RECENT}) WHERE event_type = 'purchase'",
)
def visitors_with_analysis(spark, d):
    v = visits(spark, d)
    return metrics.visitors_with_analysis(v.where("event_type = 'purchase'"), _cutoff(v, 10))


_LOCAL = "strftime((created_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d')"


@query(
    "daily_visitors",
    f"SELECT {_LOCAL} AS day, count(DISTINCT visitor_id) AS visitors, count(*) AS page_views FROM ({_RECENT}) GROUP BY 1",
)
def daily_visitors(spark, d):
    v = visits(spark, d)
    return metrics.daily_visitors(v, _cutoff(v, 10))


@query(
    "top_paths",
    f"SELECT path, count(DISTINCT visitor_id) AS visitors, count(*) AS views FROM ({_RECENT}) GROUP BY 1 ORDER BY views DESC, path LIMIT 10",
)
def top_paths(spark, d):
    v = visits(spark, d)
    return metrics.top_paths(v, _cutoff(v, 10))


def runs(spark, d):
    """Orders read as analysis runs: status, times, the parts they use, intent and error."""
    o, lines = t(spark, d, "orders"), t(spark, d, "lineitem")
    parts = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("resource_ids"))
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "failed").otherwise("analyzing")
    joined = o.join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    created = F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 86_400)
    return joined.select(
        F.col("o_orderkey").alias("id"), status.alias("status"), created.alias("created_at"),
        (created + F.make_dt_interval(secs=F.col("o_custkey") % 997 + 5)).alias("updated_at"),
        F.coalesce("resource_ids", F.array().cast("array<bigint>")).alias("resource_ids"),
        F.when(F.col("o_custkey") % 3 == 0, " ").otherwise(F.col("o_orderpriority")).alias("user_intent"),
        F.when(status == "failed", F.concat(F.lit("could not load "), F.repeat(F.col("o_orderpriority"), 12))).alias("error"),
    )


_RUNS = """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'failed' ELSE 'analyzing' END AS status,
  o_orderdate + to_seconds(o_orderkey % 86400) AS created_at, o_orderdate + to_seconds(o_orderkey % 86400) + to_seconds(o_custkey % 997 + 5) AS updated_at,
  coalesce(n_parts, 0) AS n_parts, CASE WHEN o_custkey % 3 = 0 THEN ' ' ELSE o_orderpriority END AS user_intent,
  CASE WHEN o_orderstatus = 'O' THEN 'could not load ' || repeat(o_orderpriority, 12) END AS error, (o_custkey % 997 + 5)::DOUBLE AS duration
  FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
_RUN_CUT = f"(SELECT max(created_at) - INTERVAL 365 DAY FROM ({_RUNS}))"

_STATS = """count(*) AS count, round(avg(duration), 1) AS mean_sec, round(median(duration), 1) AS median_sec, round(quantile_cont(duration, 0.9), 1) AS p90_sec,
  max(duration) AS max_sec, min(duration) AS min_sec"""


@query("duration_stats", f"SELECT status, {_STATS} FROM ({_RUNS}) GROUP BY status")
def duration_stats(spark, d):
    return metrics.duration_stats(metrics.with_duration(runs(spark, d)), by=["status"])


@query(
    "session_gap_stats",
    """WITH g AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS gap FROM events),
       s AS (SELECT gap / 1e6 AS duration FROM g WHERE gap IS NOT NULL)
       SELECT count(*) AS count, round(avg(duration), 1) AS mean_sec, round(median(duration), 1) AS median_sec, round(quantile_cont(duration, 0.9), 1) AS p90_sec, round(max(duration), 1) AS max_sec, round(min(duration), 1) AS min_sec FROM s""",
)
def session_gap_stats(spark, d):
    """Gaps inside ten-minute slots, and from a slot to the last event of the one before it."""
    from pyspark.sql import Window as W

    day = ["user_id", "day"]
    e = t(spark, d, "events").select(
        "user_id", "event_id", "ts", F.to_date("ts").alias("day"),
        F.floor((F.hour("ts") * 60 + F.minute("ts")) / 10).alias("slot"),
    )
    within = F.lag("ts").over(W.partitionBy(*day, "slot").orderBy("ts", "event_id"))
    ends = e.groupBy(*day, "slot").agg(F.max("ts").alias("last"))  # at most 144 per user and day
    before = ends.select(*day, "slot", F.lag("last").over(W.partitionBy(*day).orderBy("slot")).alias("before"))
    rows = e.withColumn("within", within).join(before, [*day, "slot"])
    gaps = rows.select(F.coalesce("within", "before").alias("created_at"), F.col("ts").alias("updated_at")).where("created_at is not null")
    return metrics.duration_stats(metrics.with_duration(gaps))


@query(
    "run_counts",
    f"""SELECT status, count(*) AS runs, count(*) FILTER (trim(user_intent) <> '') AS with_user_intent, count(*) FILTER (n_parts >= 2) AS two_dataset_runs,
               count(*) FILTER (created_at >= {_RUN_CUT}) AS recent_in_window FROM ({_RUNS}) GROUP BY status""",
)
def run_counts(spark, d):
    r = runs(spark, d)
    return metrics.run_counts(r, _cutoff(r, 365))


@query(
    "daily_runs",
    f"SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS runs FROM ({_RUNS}) WHERE created_at >= {_RUN_CUT} GROUP BY 1",
)
def daily_runs(spark, d):
    r = runs(spark, d)
    return metrics.daily_runs(r, _cutoff(r, 365))


@query(
    "top_datasets",
    f"""WITH r AS ({_RUNS}), u AS (SELECT l_partkey AS resource_id, count(DISTINCT l_orderkey) AS uses FROM lineitem JOIN r ON id = l_orderkey WHERE created_at >= {_RUN_CUT} GROUP BY 1 ORDER BY uses DESC, 1 LIMIT 20)
        SELECT resource_id, coalesce(p_name, resource_id::VARCHAR) AS title, coalesce(p_brand, 'unknown') AS portal, uses FROM u LEFT JOIN part ON p_partkey = resource_id AND p_size > 5""",
)
def top_datasets(spark, d):
    r = runs(spark, d)
    catalog = t(spark, d, "part").where("p_size > 5").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("portal")
    )
    return metrics.top_datasets(r, catalog, _cutoff(r, 365))


@query(
    "failure_reasons",
    f"SELECT left(error, 120) AS reason, count(*) AS count FROM ({_RUNS}) WHERE status = 'failed' GROUP BY 1 ORDER BY count DESC, reason LIMIT 8",
)
def failure_reasons(spark, d):
    return metrics.failure_reasons(runs(spark, d))


def _dashboard_sql(where):
    measures = {
        "count": "count(*)", "mean_sec": "round(avg(duration), 1)", "median_sec": "round(median(duration), 1)",
        "p90_sec": "round(quantile_cont(duration, 0.9), 1)", "max_sec": "max(duration)", "min_sec": "min(duration)",
    }
    parts = [
        "SELECT 'status' AS section, status AS label, count(*)::DOUBLE AS value FROM r GROUP BY ALL",
        "SELECT 'day', day, count(*)::DOUBLE FROM r GROUP BY ALL",
        "SELECT 'total', 'count', count(*)::DOUBLE FROM r", "SELECT 'total', 'two_dataset', (count(*) FILTER (n_parts >= 2))::DOUBLE FROM r",
    ]
    parts += [f"SELECT 'duration_all', '{k}', ({v})::DOUBLE FROM r" for k, v in measures.items()]
    parts += [f"SELECT 'duration_complete', '{k}', ({v})::DOUBLE FROM r WHERE status = 'complete'" for k, v in measures.items()]
    parts.append("SELECT * FROM (SELECT 'failure', left(error, 120), count(*)::DOUBLE AS c FROM r WHERE status = 'failed' GROUP BY ALL ORDER BY c DESC, 2 LIMIT 6)")
    return f"WITH a AS (SELECT *, {_LOCAL} AS day FROM ({_RUNS})), r AS (SELECT * FROM a WHERE {where}) " + " UNION ALL ".join(parts)


@query(
    "range_dashboard_last_30_days",
    _dashboard_sql("day >= strftime((SELECT max(day)::DATE FROM a) - INTERVAL 29 DAY, '%Y-%m-%d')"),
)
def range_dashboard_last_30_days(spark, d):
    return metrics.range_dashboard(metrics.in_range(runs(spark, d), "30d"))


@query("range_dashboard_custom", _dashboard_sql("day BETWEEN '1997-03-01' AND '1998-02-28'"))
def range_dashboard_custom(spark, d):
    return metrics.range_dashboard(metrics.in_range(runs(spark, d), "custom", "1998-02-28", "1997-03-01"))


@query(
    "run_snapshot",
    f"""WITH n AS (SELECT * FROM ({_RUNS}) ORDER BY created_at DESC, id DESC LIMIT 50)
        SELECT id, status, n_parts::BIGINT AS resource_count, duration AS duration_sec, error, count(*) OVER (PARTITION BY status) AS status_total FROM n""",
)
def run_snapshot(spark, d):
    return metrics.run_snapshot(runs(spark, d)).withColumn("resource_count", F.col("resource_count").cast("bigint"))


@query(
    "recover_stale_runs",
    f"""WITH u AS (SELECT user_id, max(ts) AS updated_at, count(*) AS n, arg_max(event_type, ts) AS last_event FROM events GROUP BY 1),
          r AS (SELECT *, CASE last_event WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'complete' WHEN 'view' THEN 'ingesting' ELSE 'analyzing' END AS status, user_id % 2 = 0 AS large FROM u),
          s AS (SELECT *, status IN ('ingesting', 'analyzing') AND (SELECT max(ts) FROM events) - updated_at > to_minutes(CASE WHEN large THEN 60 ELSE 25 END) AS stale FROM r)
        SELECT user_id AS id, CASE WHEN stale THEN 'failed' ELSE status END AS status, stale AS recovered,
               CASE WHEN NOT stale THEN NULL WHEN status = 'ingesting' AND large THEN '{rules.STALE_LARGE_DOWNLOAD}' WHEN status = 'ingesting' THEN '{rules.STALE_DOWNLOAD}' ELSE '{rules.STALE_ANALYSIS}' END AS error FROM s""",
)
def recover_stale_runs(spark, d):
    e = t(spark, d, "events")
    last = F.max_by("event_type", "ts")
    status = F.when(last == "error", "failed").when(last == "purchase", "complete").when(last == "view", "ingesting").otherwise("analyzing")
    active = e.groupBy(F.col("user_id").alias("id")).agg(
        status.alias("status"), F.max("ts").alias("updated_at"), F.lit("run").alias("phase"), F.lit(None).cast("string").alias("error")
    ).withColumn("large", F.col("id") % 2 == 0)
    return metrics.recover_stale(active, e.agg(F.max("ts")).scalar()).select("id", "status", "recovered", "error")


# --- usage ledger -------------------------------------------------------------------------


def _calls(spark, d):
    e = t(spark, d, "events")
    model = F.when(F.col("event_type") == "view", "claude-haiku-4-5").when(F.col("event_type") == "click", "claude-sonnet-4-6").otherwise("other")
    return e.select(
        model.alias("model"), F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "error", 0).otherwise(F.col("user_id") * 10).alias("tokens_in"),
        F.when(F.col("event_type") == "error", None).otherwise(F.col("event_id") % 700).alias("tokens_out"),
    )


_LEDGER = """SELECT strftime(ts, '%Y-%m') AS month, sum(i)::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out, round(sum(i / 1e6 * pi + o / 1e6 * po), 6) AS cost_usd, count(*) AS calls FROM (
  SELECT ts, CASE WHEN event_type = 'error' THEN 0 ELSE user_id * 10 END AS i, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 700 END AS o,
         CASE event_type WHEN 'view' THEN 1.0 ELSE 3.0 END AS pi, CASE event_type WHEN 'view' THEN 5.0 ELSE 15.0 END AS po FROM events) WHERE i <> 0 OR o <> 0 GROUP BY 1"""


@query("usage_ledger", _LEDGER)
def usage_ledger(spark, d):
    return metrics.usage_ledger(_calls(spark, d)).withColumn("cost_usd", F.round("cost_usd", 6))


@query("budget_state", f"SELECT month, cost_usd >= 50 AS over_budget FROM ({_LEDGER})")
def budget_state(spark, d):
    return metrics.budget_state(metrics.usage_ledger(_calls(spark, d)), 50.0).select("month", "over_budget")


# --- ids, paths, days ------------------------------------------------------------------------


_UUID = "printf('%08x-0000-{}000-8000-%012x', user_id, event_id)"


@query(
    "visitor_ids_and_paths",
    f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE {_UUID.format(4)} END AS visitor_id,
               left(CASE WHEN event_id % 2 = 0 THEN '/' ELSE '/' END || event_type || repeat('/x', (event_id % 300)::INT), 512) AS path FROM events""",
)
def visitor_ids_and_paths(spark, d):
    e = t(spark, d, "events")
    version = F.when(F.col("event_id") % 3 == 0, "9").otherwise("4")
    raw = F.format_string("  %08X-0000-%s000-8000-%012x ", "user_id", version, "event_id")
    path = F.concat(F.when(F.col("event_id") % 2 == 0, " /").otherwise(" "), "event_type", F.repeat(F.lit("/x"), (F.col("event_id") % 300).cast("int")))
    return e.select("event_id", text.visitor_id(raw).alias("visitor_id"), text.page_path(path).alias("path"))


@query(
    "local_day_window",
    """SELECT event_type, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M') AS first_seen FROM events
       WHERE ts BETWEEN TIMESTAMP '2024-01-06 05:00:00' AND TIMESTAMP '2024-01-08 04:59:59' GROUP BY 1""",
)
def local_day_window(spark, d):
    """Events of one local weekend, filtered by its UTC bounds."""
    start, end = times.local_bounds("2024-01-06", "2024-01-07")
    e = t(spark, d, "events").where(F.col("ts").cast("timestamp").between(start, end))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm").alias("first_seen"))


@query(
    "recency_coalesce",
    """SELECT user_id, strftime(max(CASE event_id % 5 WHEN 4 THEN TIMESTAMP '0001-01-01' ELSE date_trunc('second', ts) END), '%Y-%m-%d %H:%M:%S') AS newest FROM events GROUP BY 1""",
)
def recency_coalesce(spark, d):
    """The first readable of several time fields: epoch seconds, epoch milliseconds, ISO texts, or none."""
    e = t(spark, d, "events")
    k, ts = F.col("event_id") % 5, F.date_trunc("second", F.col("ts").cast("timestamp"))
    rows = e.select(
        "user_id",
        F.when(k == 0, F.unix_seconds(ts).cast("string")).when(k == 1, F.unix_millis(ts).cast("string")).when(k == 4, "0").alias("epoch"),
        F.when(k == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 3, "soon").alias("modified"),
        F.when(k == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+0000'")).alias("created"),
    )
    seen = times.first_time(times.epoch_time(F.col("epoch")), times.iso_time(F.col("modified")), times.iso_time(F.col("created")))
    return rows.groupBy("user_id").agg(F.date_format(F.max(seen), "yyyy-MM-dd HH:mm:ss").alias("newest"))


@query(
    "large_download_flag",
    """SELECT portal, large, count(*) AS n FROM (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'nyc_open_data' ELSE 'data_gov' END AS portal,
       (o_custkey % 2 = 0 AND o_totalprice::BIGINT >= 50000) OR o_totalprice::BIGINT >= 100000 AS large FROM orders) GROUP BY ALL""",
)
def large_download_flag(spark, d):
    o = t(spark, d, "orders").select(
        F.when(F.col("o_custkey") % 2 == 0, "nyc_open_data").otherwise("data_gov").alias("portal"),
        F.round("o_totalprice").cast("bigint").alias("hint"),
    )
    return o.groupBy("portal", metrics.is_large_download(F.col("portal"), F.col("hint")).alias("large")).agg(F.count(F.lit(1)).alias("n"))
