"""Reassembly of chunked and paged downloads, and the byte cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def assemble_chunks(rows: DataFrame, chunks: DataFrame, row_target: int | None = None) -> DataFrame:
    """Rows of the contiguous good prefix of chunks, trimmed to the target if one is given.

    `chunks` has chunk, ok (one row per requested chunk); `rows` has chunk, pos.
    A failed, missing or empty chunk ends the prefix; nothing remains when the
    first one is bad. The cut is one number, so rows are only filtered.
    """
    sizes = rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    state = chunks.join(sizes, "chunk", "left")
    bad = ~F.coalesce(F.col("ok"), F.lit(False)) | (F.coalesce("n", F.lit(0)) == 0)
    first_bad = state.agg(F.min(F.when(bad, F.col("chunk")))).scalar()
    last = state.agg(F.max("chunk")).scalar()
    good = rows.where(F.col("chunk") < F.coalesce(first_bad, last + 1))
    return good if row_target is None else good.orderBy("chunk", "pos").limit(row_target)


def assemble_pages(rows: DataFrame, pages: DataFrame, cap: int | None = None) -> DataFrame:
    """Rows of each source's pages in order, until an empty or failed page, the page count or the total.

    `pages` has source, page, ok, pages, total (one row per page, page 1 first);
    `rows` has source, page, pos. Only page rows are ordered per source; a data
    row is kept when its own offset is below min(cap, total).
    """
    sizes = rows.groupBy("source", "page").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("source").orderBy("page")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    bad = ~F.coalesce(F.col("ok"), F.lit(False)) | (F.coalesce("n", F.lit(0)) == 0) | (F.col("page") != F.col("expected"))
    most = F.lit((1 << 63) - 1 if cap is None else cap)
    limit = F.least(most, F.coalesce("total", most))
    state = (
        pages.join(sizes, ["source", "page"], "left")
        .withColumn("expected", F.row_number().over(order))
        .withColumn("bad_so_far", F.max(bad.cast("int")).over(upto))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn("limit", limit)
        .where((F.col("bad_so_far") == 0) & (F.col("before") < F.col("limit")))
        .where(F.col("page") <= F.coalesce("pages", F.lit(1)))
        .select("source", "page", "before", "limit")
    )
    return rows.join(state, ["source", "page"]).where(F.col("before") + F.col("pos") < F.col("limit")).drop("before", "limit")


def row_bytes(columns: list[str]) -> Column:
    """Serialized size of a row in a JSON list, separator included."""
    return (F.octet_length(F.to_json(F.struct(*columns))) + 1).cast("bigint")


def _crossing(sized: DataFrame, limit: int, ranges: int, few: int) -> tuple | None:
    """(low, high, before): where the sum of n in the order of `value` first exceeds the limit.

    `before` is the sum below low; None if all rows together stay within the limit. A pass sums n
    per range of values and goes on inside the one that exceeds the limit, until that one has at
    most `few` rows. A range always holds less than the one before it, as its lowest and its highest
    value are parted; values too close to part end the search.
    """
    value = F.col("value")
    low, high = sized.agg(F.min(value), F.max(value)).first()
    if low is None:
        return None
    before = 0
    while True:
        step = (float(high) - float(low)) / ranges
        place = F.floor((value.cast("double") - float(low)) / step) if step > 0 else (value == high).cast("int")
        parts = (
            sized.where(value.between(F.lit(low), F.lit(high))).groupBy(place.alias("part"))
            .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min(value).alias("low"), F.max(value).alias("high"))
            .orderBy("part").collect()
        )  # a row per range
        for part in parts:
            if before + part["n"] > limit:
                break
            before += part["n"]
        else:
            return None
        if part["rows"] <= few or (part["low"], part["high"]) == (low, high):
            return part["low"], part["high"], before
        low, high = part["low"], part["high"]


def trim_to_bytes(df: DataFrame, order: str, byte_cap: int, ranges: int = 1_024, few: int = 10_000) -> DataFrame:
    """The longest prefix in `order` whose JSON list fits the cap, as a filter on `order`.

    `order` must be unique and numeric; rows where it is null are in no prefix. A row takes at
    least three bytes, so counts of `order` alone first bound the values that can fit, and only
    rows up to there are measured. Only the rows of the range where the cap falls, at most `few`, are
    ordered. The rows themselves are neither moved nor joined.
    """
    key = F.col(f"`{order}`")
    roof = _crossing(df.select(key.alias("value"), F.lit(1).alias("n")), byte_cap // 3, ranges, few)
    kept = df.where(key.isNotNull()) if roof is None else df.where(key <= F.lit(roof[1]))
    sized = kept.select(key.alias("value"), row_bytes([f"`{c}`" for c in df.columns]).alias("n"))
    edge = _crossing(sized, byte_cap - 1, ranges, few)
    if edge is None:
        return kept
    low, high, before = edge
    running = F.sum("n").over(W.orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow))
    last = (
        sized.where(F.col("value").between(F.lit(low), F.lit(high))).withColumn("upto", running + before)
        .where(F.col("upto") < byte_cap).agg(F.max("value")).first()[0]
    )
    return df.where(key < F.lit(low)) if last is None else df.where(key <= F.lit(last))
