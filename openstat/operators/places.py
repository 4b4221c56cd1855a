"""Filtered, de-duplicated card searches over places and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from openstat import rules


def first_per(df: DataFrame, keys: list[Column], order: list) -> DataFrame:
    """First row per key in the given order; Spark trims per task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def search_places(places: DataFrame, area: str = "", category: str = "", top: int = 8) -> DataFrame:
    """Places by category and area, best grade first, one card per id, refined by area text.

    Columns: id, name, category, borough, street, grade, address. A known area
    maps to its borough; any other is looked for in the street or name. Rows of
    the same id are one card before the first `top` are taken. When nothing matches at all, the first places are shown instead.
    """
    rows = places.where("name is not null")
    if category:
        rows = rows.where(F.upper("category").contains(category.upper()))
    if area:
        borough = rules.AREA_TO_BOROUGH.get(area.lower())
        if borough:
            rows = rows.where(F.col("borough") == borough)
        else:
            rows = rows.where(F.upper("street").contains(area.upper()) | F.upper("name").contains(area.upper()))
    order = [F.asc_nulls_last("grade"), F.asc("name"), F.asc("id")]
    cards = first_per(rows, [F.col("id")], order).orderBy(*order).limit(top)
    if area:
        inside = F.lower(F.coalesce("address", F.lit(""))).contains(area.lower()) | F.lower("name").contains(area.lower())
        refined = cards.where(inside)
        keep_all = refined.agg(F.count(F.lit(1)) == 0).scalar()
        cards = cards.where(inside | keep_all)
    none = cards.agg(F.count(F.lit(1)) == 0).scalar()
    fallback = places.orderBy("id").limit(6).where(none)
    return cards.withColumn("source", F.lit("match")).unionByName(fallback.withColumn("source", F.lit("fallback")))


def search_events(events: DataFrame, area: str = "", category: str = "", keyword: str = "", today: str = "") -> DataFrame:
    """Events by category, area and keyword, first eight; the first five of all when filters match none.

    Columns: id, name, venue, area, city, category, date. Arts and theater match each other.
    """
    blob = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("name", "venue", "area", "city", "category")]))
    match = F.lit(True)
    wanted = category.strip().lower()
    if wanted:
        same = F.lower(F.coalesce("category", F.lit(""))) == wanted
        soft = F.lit(wanted in ("arts", "theater")) & F.col("category").isin("arts", "theater")
        match = match & (same | soft)
    for text in (area.strip().lower(), keyword.strip().lower()):
        if text:
            match = match & blob.contains(text)
    dated = events.withColumn("date", F.coalesce(F.nullif(F.col("date"), F.lit("")), F.lit(today)))
    found = dated.where(match).orderBy("id").limit(8)
    if not (wanted or area.strip() or keyword.strip()):
        return found
    none = found.agg(F.count(F.lit(1)) == 0).scalar()
    return found.unionByName(dated.orderBy("id").limit(5).where(none))


def dedupe_cards(cards: DataFrame, order: list) -> DataFrame:
    """First card per type and case-insensitive name."""
    return first_per(cards, [F.coalesce("type", F.lit("")), F.lower(F.coalesce("name", F.lit("")))], order)
