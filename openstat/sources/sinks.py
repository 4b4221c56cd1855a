"""Named tables and analysis results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Create or replace a stored table and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_results(tables: dict[str, DataFrame], folder: str) -> None:
    """One JSON folder per result table: findings, display, charts, summary, report."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")


def read_results(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.json(f"{folder.rstrip('/')}/{name}")
