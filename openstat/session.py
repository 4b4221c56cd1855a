"""Session, table loading and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName("openstat")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder. Analysis days and years are UTC, so the session is too."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster in spark.checkpoint.dir.

    Where that is unset it is a folder in the warehouse, which all executors share too.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    context.setCheckpointDir(folder)
    return folder


#: Rows that a task of a counted table gets, where there are more than cores times as many.
TASK_ROWS = 1 << 16


def store(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write a wide table once to the shared folder and read it back as columns.

    Later passes then read only the columns they use, and Spark knows its size. Where the
    caller knows how many rows there are at most, the tasks follow from that: a short table
    is not written as one file for each partition of a shuffle.
    """
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder so later steps see fixed values."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
