"""Seeded samples of an exact size and the sample-size rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from openstat import rules

_HISTOGRAM_BITS = 14


def analysis_rows(
    available: Column,
    cap: int = rules.ROW_CAP,
    floor: int = rules.MIN_SAMPLE,
    pct: float = rules.SAMPLE_PCT,
) -> Column:
    """Rows to analyze: all up to the cap, then a share between floor and cap."""
    share = F.bround(available * F.lit(pct), 0).cast("bigint")
    return (
        F.when(available <= 0, F.lit(0))
        .when(available <= cap, available)
        .otherwise(F.least(F.lit(cap), F.greatest(F.lit(floor), share)))
        .cast("bigint")
    )


def sampling_tier(total: Column) -> Column:
    return (
        F.when(total <= 100_000, "full_ok")
        .when(total <= 1_000_000, "recommend_filter")
        .otherwise("require_filter")
    )


def sample_rows(df: DataFrame, n: int, seed: int = rules.SEED, key: list[str] | None = None) -> DataFrame:
    """Exactly min(n, rows) rows: those whose seeded hash is smallest.

    The choice depends on the rows alone, so it survives repartitioning and task
    retries. One aggregate over hash ranges finds the range where the n-th row
    falls; whole ranges below it are kept by a plain filter, and only the one
    range on the edge is ordered.
    """
    hashed = df.withColumn("__h", F.xxhash64(*(key or df.columns), F.lit(seed)))
    bucket = F.shiftright("__h", 64 - _HISTOGRAM_BITS)
    sizes = hashed.groupBy(bucket.alias("b")).count().orderBy("b").collect()
    kept, edge = 0, None
    for row in sizes:
        if kept + row["count"] > n:
            edge = row["b"]
            break
        kept += row["count"]
    if edge is None:
        return df
    below = hashed.where(bucket < edge)
    on_edge = hashed.where(bucket == edge).orderBy("__h", *(key or df.columns)).limit(n - kept)
    return below.unionByName(on_edge).drop("__h")


def analysis_sample(
    df: DataFrame,
    predicate: str | None = None,
    cap: int | None = None,
    floor: int = rules.MIN_SAMPLE,
    pct: float = rules.SAMPLE_PCT,
    seed: int = rules.SEED,
) -> DataFrame:
    """Guarded filter; with a cap also the sample-size rule and the seeded sample."""
    from openstat.operators.filters import guarded_filter

    rows = guarded_filter(df, predicate)
    if cap is None:
        return rows
    total = rows.count()
    if total <= cap:
        return rows
    target = min(cap, max(floor, round(pct * total)))
    return sample_rows(rows, target, seed)


def model_sample(df: DataFrame, columns: list[str], n: int | None = None,
                 key: list[str] | None = None) -> DataFrame:
    """Numeric columns of all or n sampled rows, rows with a null dropped after."""
    keys = [k for k in (key or []) if k not in columns]
    chosen = df if n is None else sample_rows(df, n, key=key)
    return chosen.select(
        *keys, *[F.col(c).try_cast("double").alias(c) for c in columns]
    ).dropna(subset=columns)
