"""Column glossary and the per-table context bundle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from openstat.functions.text import column_description, column_label, normalize_key
from openstat.operators.profile import profile_columns


def glossary(names: DataFrame) -> DataFrame:
    """Label and description per distinct normalized name, first position wins."""
    first = W.partitionBy("key").orderBy("position")
    return (
        names.withColumn("key", normalize_key(F.col("name")))
        .withColumn("r", F.row_number().over(first)).where("r = 1")
        .select("position", "name", column_label(F.col("name")).alias("label"), column_description(F.col("name")).alias("description"))
    )


def table_context(tables: dict[str, DataFrame], titles: dict[str, str], sample: int = 3) -> DataFrame:
    """One row per table: column entries, facts and a few sample rows, as JSON."""
    parts = []
    for name, df in tables.items():
        columns = profile_columns(df).orderBy("position").agg(
            F.to_json(
                F.transform(
                    F.array_sort(F.collect_list(F.struct(
                        "position", "name", "kind", F.round("null_pct", 2).alias("null_pct"), "nunique",
                        F.round("low", 4).alias("min"), F.round("high", 4).alias("max"), F.round("mean", 4).alias("mean"),
                    ))), lambda s: s
                )
            ).alias("columns"),
            F.max("n_rows").alias("n_rows"),
        )
        chosen = df.orderBy(F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))).limit(sample)  # the same rows each time
        rows = chosen.agg(F.to_json(F.collect_list(F.struct("*"))).alias("sample_rows"))
        parts.append(
            columns.withColumn("sample_rows", rows.scalar()).select(
                F.lit(name).alias("resource_id"), F.lit(titles.get(name, name)).alias("title"), "n_rows", "columns", "sample_rows"
            )
        )
    return reduce(DataFrame.unionByName, parts)
