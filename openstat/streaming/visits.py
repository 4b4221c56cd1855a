"""Structured Streaming forms of the daily visit counts and stale-run recovery."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from openstat import rules
from openstat.functions.times import LOCAL_ZONE


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """One table as a stream, a single file or a folder of part files; the schema is read from the files."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{path[:-1]}[t]")  # a glob meets the file as well as the folder, and this one nothing else
    )


def daily_paths(visits: DataFrame, late: str = "2 hours", zone: str = LOCAL_ZONE) -> DataFrame:
    """Views and distinct visitors per local day and path.

    The local day is a one-day window over the time shifted to local time. Views
    per visitor are the first aggregate; a second one folds visitors, so state
    holds a row per (day, path, visitor) and is dropped once the watermark passes
    the day. Late rows within `late` still count.
    """
    local = visits.withColumn("local_time", F.from_utc_timestamp(F.col("created_at").cast("timestamp"), zone))
    per_visitor = (
        local.withWatermark("local_time", late)
        .groupBy(F.window("local_time", "1 day").alias("w"), "path", "visitor_id")
        .agg(F.count(F.lit(1)).alias("views"))
    )
    per_path = per_visitor.groupBy(F.window(F.window_time("w"), "1 day").alias("day"), "path").agg(
        F.count("visitor_id").alias("visitors"), F.sum("views").alias("page_views")
    )
    return per_path.select(
        F.date_format(F.col("day.start"), "yyyy-MM-dd").alias("day"), "path", "visitors", "page_views"
    )


class StaleRuns(StatefulProcessor):
    """Reports a run as failed when no heartbeat arrives within its limit of event time.

    State per run is its newest heartbeat and whether it is large; one timer per
    heartbeat fires when the watermark passes the limit, and a newer heartbeat
    replaces it. A finished run drops its state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = T.StructType([
            T.StructField("updated_ms", T.LongType()), T.StructField("status", T.StringType()), T.StructField("large", T.BooleanType()),
        ])
        self.last = handle.getValueState("last", schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest = None
        for batch in rows:
            top = batch.sort_values("updated_ms").iloc[-1]
            if newest is None or top["updated_ms"] >= newest["updated_ms"]:
                newest = top
        if newest is None:
            return
        if self.last.exists() and self.last.get()[0] > int(newest["updated_ms"]):
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if newest["status"] not in rules.ACTIVE_STATES:
            self.last.clear()
            return
        large = bool(newest["large"])
        self.last.update((int(newest["updated_ms"]), str(newest["status"]), large))
        minutes = rules.STALE_MINUTES_LARGE if large else rules.STALE_MINUTES
        self.handle.registerTimer(int(newest["updated_ms"]) + minutes * 60_000)
        return
        yield  # this method only sets state; rows come from timers

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        updated, status, large = self.last.get()
        self.last.clear()
        if status == "ingesting":
            error = rules.STALE_LARGE_DOWNLOAD if large else rules.STALE_DOWNLOAD
        else:
            error = rules.STALE_ANALYSIS
        yield pd.DataFrame({"id": [key[0]], "status": ["failed"], "last_seen_ms": [updated], "error": [error]})

    def close(self) -> None:
        pass


def stale_runs(heartbeats: DataFrame, late: str = "1 minute") -> DataFrame:
    """Failed runs from a stream of heartbeats: id, status, large, updated_at.

    Needs the RocksDB state store (see `with_rocksdb`).
    """
    rows = heartbeats.withColumn("updated_at", F.col("updated_at").cast("timestamp")).withWatermark("updated_at", late)
    rows = rows.withColumn("updated_ms", F.unix_millis("updated_at"))
    return rows.groupBy("id").transformWithStateInPandas(
        statefulProcessor=StaleRuns(), outputStructType="id long, status string, last_seen_ms long, error string",
        outputMode="Append", timeMode="EventTime",
    )


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Process everything available, append to a table under `folder`, and read it back."""
    spark = stream.sparkSession
    q = (
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
