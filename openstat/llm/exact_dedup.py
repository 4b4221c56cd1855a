"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so (a sentence end at least 256
characters after the last cut, 2 048 at most), so equal passages give equal chunks
wherever they stand. Chunks move once, to verify that a 64-bit identifier stands
for one chunk only; after that, documents are their ordered identifier lists, a
few bytes per page, and equal lists are equal texts.

Null text counts as empty. Of equal texts the largest id stays; null ids sort
lowest; of rows that repeat id and text one stays. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from openstat.session import store

#: A chunk: to the first sentence end after 255 characters, or 2 048 without one.
CHUNK = r"(?s).{255,2047}?[.!?\n]|.{1,2048}"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def chunk_recipes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    identify: Callable[[Column], Column] = lambda chunk: F.xxhash64(chunk),
) -> DataFrame:
    """doc_id, row_id, text_sha256, size, recipe: one row per row of `docs`, stored.

    Identifiers are verified against the chunks themselves. Where two chunks share
    one, both get a variant number, so equal recipes always mean equal texts.
    """
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    rows = store(
        texts.select(
            "doc_id", F.monotonically_increasing_id().alias("row_id"),
            F.sha2("text", 256).alias("text_sha256"),
            F.octet_length("text").cast("long").alias("size"),
            F.transform(chunks(F.col("text")), lambda chunk: identify(chunk)).alias("recipe"),
        )
    )
    pieces = texts.select(F.explode(chunks(F.col("text"))).alias("chunk"))
    distinct = pieces.select(identify(F.col("chunk")).alias("id"), "chunk").distinct()
    shared = store(distinct.groupBy("id").count().filter("count > 1").select("id"))
    if shared.isEmpty():
        return rows
    variants = distinct.join(shared, "id", "left_semi").select(
        "id", "chunk",
        F.row_number().over(Window.partitionBy("id").orderBy("chunk")).cast("long").alias("variant"),
    )
    placed = texts.select(
        F.sha2("text", 256).alias("text_sha256"), F.posexplode(chunks(F.col("text")))
    ).distinct().withColumn("id", identify(F.col("col")))
    told = (
        placed.join(variants, (placed.id == variants.id) & (placed.col == variants.chunk))
        .groupBy("text_sha256")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "variant"))).alias("told"))
    )
    marked = F.concat(
        "recipe", F.flatten(F.transform("told", lambda x: F.array(x.pos.cast("long"), x.variant)))
    )
    return rows.join(told, "text_sha256", "left").select(
        "doc_id", "row_id", "text_sha256", "size",
        F.coalesce(marked, "recipe").alias("recipe"),
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    identify: Callable[[Column], Column] = lambda chunk: F.xxhash64(chunk),
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the number of chunks."""
    rows = chunk_recipes(docs, id_col, text_col, identify)
    groups = rows.groupBy("size", "recipe").agg(
        F.max(F.struct("doc_id", (-F.col("row_id")).alias("turn"))).alias("last"),
        F.count("*").alias("group_size"),
    )
    return rows.join(groups, ["size", "recipe"]).select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size",
        (F.col("row_id") == -F.col("last.turn")).alias("kept"), "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )
