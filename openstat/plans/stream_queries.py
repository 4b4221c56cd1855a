"""Registered queries: streaming forms over the event log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from openstat.plans.registry import query
from openstat.session import read_table as t, shared_dir
from openstat.streaming import visits

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _visit_stream(spark, d):
    t(spark, d, "events")  # sets the session zone
    e = visits.stream_table(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("visitor_id"), F.concat(F.lit("/"), "event_type").alias("path"), F.col("ts").alias("created_at"))


_LOCAL = "strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d')"


@query(
    "stream_daily_paths",
    f"""WITH v AS (SELECT {_LOCAL} AS day, '/' || event_type AS path, user_id FROM events),
             w AS (SELECT strftime(((SELECT max(ts) FROM events) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' - INTERVAL 2 HOUR, '%Y-%m-%d') AS open_day)
        SELECT day, path, count(DISTINCT user_id) AS visitors, count(*) AS page_views FROM v, w WHERE day < open_day GROUP BY ALL""",
)
def stream_daily_paths(spark, d):
    """Days the watermark has closed; the newest day is still open."""
    return visits.run_available(visits.daily_paths(_visit_stream(spark, d)), _folder(spark, "daily-paths"))


@query("stream_stale_runs")
def stream_stale_runs(spark, d):
    """Users read as runs: active ones whose last event lies too far behind the newest."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    try:
        t(spark, d, "events")
        e = visits.stream_table(spark, d, "events").select(
            F.col("user_id").alias("id"),
            F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "complete")
            .when(F.col("event_type") == "view", "ingesting").otherwise("analyzing").alias("status"),
            (F.col("user_id") % 2 == 0).alias("large"), F.col("ts").alias("updated_at"),
        )
        return visits.run_available(visits.stale_runs(e), _folder(spark, "stale-runs"))
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
