"""Catalog search: relevance, quality, themes, curated paths and suggestions.

Query words and the fixed keyword lists become column expressions, so matching a
catalog is one narrow pass without a join. Catalog rows carry: id, portal, title,
description, tags, format, row_count_hint, columns, search_text, ingestible.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from openstat import rules
from openstat.functions.text import literal_map, search_tokens, tokenize
from openstat.operators.joins import complete_members
from openstat.session import cut_lineage


def _words(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _total(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values, F.lit(0.0))


def token_match(tokens: list[str]) -> tuple[Column, Column]:
    """Hits, and the hit share plus .15 per whole word among the first 200 characters."""
    text = F.lower(F.coalesce("search_text", F.lit("")))
    head = F.left(text, F.lit(200))
    hits = [F.when(text.contains(w), 1).otherwise(0) for w in tokens]
    whole = [F.when(head.rlike(rf"\b{re.escape(w)}\b"), 0.15).otherwise(0.0) for w in tokens]
    count = reduce(lambda a, b: a + b, hits, F.lit(0))
    return count, count / F.lit(max(len(tokens), 1)) + _total(whole)


def quality_prior(featured: Column, curated: Column) -> Column:
    """How good an analysis candidate a row is before any query, 0 to 1."""
    hint, columns = F.coalesce("row_count_hint", F.lit(0)), F.coalesce(F.size("columns"), F.lit(0))
    score = (
        F.when(featured, 0.45).when(curated, 0.25).otherwise(0.0)
        + F.when(hint >= 10_000, 0.35).when(hint >= 1_000, 0.25).when(hint >= 100, 0.12).otherwise(0.0)
        + F.when(F.col("portal") == "world_bank", 0.15).when(F.col("portal") == "fred", 0.12)
        .when(F.col("portal") == "data_gov", 0.05).otherwise(0.0)
        + F.when(F.upper(F.coalesce("format", F.lit(""))).isin("CSV", "JSON_WORLDBANK", "JSON"), 0.08).otherwise(0.0)
        + F.when(columns >= 3, 0.05).otherwise(0.0)
    )
    return F.round(F.least(score, F.lit(1.0)), 4)


def match_reason(tokens: list[str], featured: Column) -> Column:
    """Up to four matched words; without a query, why a row is worth a look."""
    if not tokens:
        return (
            F.when(featured, "Featured explore example with verified analysis path.")
            .when(F.coalesce("row_count_hint", F.lit(0)) >= 1000, "Large sample size — well suited for statistical analysis.")
        )
    title, body = F.lower(F.coalesce("title", F.lit(""))), F.coalesce("search_text", F.lit(""))
    matched = F.filter(_words(tokens), lambda w: title.contains(w) | body.contains(w))
    shown = F.concat(F.lit("Matches: "), F.array_join(F.slice(matched, 1, 4), ", "))
    more = F.size(matched) - 4
    return F.when(F.size(matched) > 0, F.when(more > 0, F.concat(shown, F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(shown))


def rank_catalog(catalog: DataFrame, query: str, featured: Column | None = None, curated: Column | None = None) -> DataFrame:
    """Adds hits, quality, combined and why; rows without a hit drop out when there is a query."""
    tokens = tokenize(query)
    featured = F.lit(False) if featured is None else featured
    curated = F.lit(False) if curated is None else curated
    hits, share = token_match(tokens)
    scored = catalog.withColumns({"hits": hits, "share": share, "quality": quality_prior(featured, curated)})
    if tokens:
        scored = scored.where("hits > 0").withColumn("combined", F.col("share") * 0.65 + F.col("quality") * 0.35)
    else:
        scored = scored.withColumn("combined", F.col("quality"))
    return scored.withColumn("why", match_reason(tokens, featured)).drop("share")


def search_page(
    catalog: DataFrame, query: str = "", portal: str | None = None, topic: str | None = None,
    page: int = 1, limit: int = 20, featured: Column | None = None, curated: Column | None = None,
) -> DataFrame:
    """One page of ranked ingestible rows with the total over all matches.

    Only rows up to the end of the page are ordered (top-k), the total is a
    separate count, so no task sees every match.
    """
    text = query.strip()
    rows = catalog.where(F.col("ingestible"))
    if portal:
        rows = rows.where(F.col("portal") == portal)
    words = [w for w in text.lower().split() if len(w) > 1]
    if words:
        rows = rows.where(reduce(lambda a, b: a | b, [F.col("search_text").contains(w) for w in words]))
    elif text:
        rows = rows.where(F.col("search_text").contains(text.lower()))
    if topic:
        rows = with_theme_scores(rows).where(F.col(f"theme_{topic}") >= 1.0)
    ranked = rank_catalog(rows, text, featured, curated)
    order = [F.desc("combined"), F.desc("quality"), F.desc("title"), F.asc("id")]
    top = ranked.orderBy(*order).limit(page * limit)
    placed = top.withColumn("position", F.row_number().over(W.orderBy(*order)))  # page * limit rows
    total = ranked.agg(F.count(F.lit(1))).scalar()
    return placed.where(F.col("position") > (page - 1) * limit).withColumn("total", total)


# --- themes ---------------------------------------------------------------------------


def with_theme_scores(catalog: DataFrame) -> DataFrame:
    """Adds one score column per theme: 3 per matching tag, 2 per keyword in the title, else 1 in the body."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))

    def filled(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    body = F.concat_ws(" ", filled(F.col("description")), filled(F.col("search_text")), filled(F.array_join(tags, " ")))
    prepared = catalog.withColumns(
        {
            "__title": F.lower(F.coalesce("title", F.lit(""))), "__body": F.lower(body),
            "__tags": F.transform(tags, lambda x: F.lower(F.trim(x))),
        }
    )
    title, text = F.col("__title"), F.col("__body")

    def score(spec: dict) -> Column:
        own = [x.lower() for x in spec["tags"]]
        tag_hits = F.size(F.filter("__tags", lambda x: x.isin(*own)))
        return tag_hits * 3.0 + _total(
            [F.when(title.contains(k), 2.0).when(text.contains(k), 1.0).otherwise(0.0) for k in spec["keywords"]]
        )

    return prepared.withColumns({f"theme_{t}": score(s) for t, s in rules.THEMES.items()}).drop("__title", "__body", "__tags")


def classify_themes(catalog: DataFrame) -> DataFrame:
    """Adds `themes`: matching theme ids, strongest first, then by id."""
    scored = F.array(*[F.struct((-F.col(f"theme_{t}")).alias("neg"), F.lit(t).alias("theme")) for t in rules.THEMES])
    kept = F.array_sort(F.filter(scored, lambda s: s["neg"] <= -1.0))
    names = [f"theme_{t}" for t in rules.THEMES]
    return with_theme_scores(catalog).withColumn("themes", F.transform(kept, lambda s: s["theme"])).drop(*names)


def theme_counts(catalog: DataFrame, paths: DataFrame) -> DataFrame:
    """Datasets per primary theme and curated paths per theme; themes without any stay, with zero."""
    primary = classify_themes(catalog.where("ingestible")).select(F.get("themes", F.lit(0)).alias("theme"))
    # one row per theme, written so that join filters are not pushed into the scoring
    counted = cut_lineage(primary.groupBy("theme").agg(F.count(F.lit(1)).alias("dataset_count")))
    by_path = paths.groupBy(F.col("topic").alias("theme")).agg(F.count(F.lit(1)).alias("path_count"))
    listed = catalog.sparkSession.createDataFrame(
        [(k, v["title"]) for k, v in rules.THEMES.items()], "theme string, title string"
    )
    return (
        listed.join(counted, "theme", "left").join(by_path, "theme", "left")
        .na.fill(0, ["dataset_count", "path_count"])
    )


# --- curated paths: path_id, title, topic, quality, description, patterns, resource_ids --


def path_weight() -> Column:
    known = F.element_at(literal_map(rules.PATH_QUALITY), F.lower("quality"))
    return F.coalesce(known, F.lit(0.1))


def match_paths(paths: DataFrame, query: str, topic: str | None = None, limit: int = 5) -> DataFrame:
    """Curated paths scored against a question, best five."""
    q = (query or "").strip().lower()
    tokens = list(tokenize(q))
    rows = paths.where(F.col("topic") == topic) if topic else paths
    if q:
        per_pattern = F.aggregate(
            F.transform(
                "patterns",
                lambda p: F.when(F.contains(F.lit(q), F.lower(p)), 1.5).otherwise(0.0)
                + F.size(F.array_intersect(search_tokens(p), _words(dict.fromkeys(tokens)))) * 0.35,
            ),
            F.lit(0.0), lambda acc, x: acc + x,
        )
        title, about = F.lower("title"), F.lower(F.coalesce("description", F.lit("")))
        in_text = [F.when(title.contains(w) | about.contains(w), 0.2).otherwise(0.0) for w in tokens]
        score = per_pattern + _total(in_text)
    else:
        score = path_weight() + (0.5 if topic else 0.0)
    scored = rows.withColumn("weight", path_weight()).withColumn("score", F.round(score + F.col("weight"), 6))
    return scored.where("score > 0.05").orderBy(F.desc("score"), F.desc("weight"), "path_id").limit(limit)


def curated_paths(paths: DataFrame, catalog: DataFrame, topic: str | None = None) -> DataFrame:
    """Valid paths, verified first, then by title. Order columns are in the result."""
    rows = paths.where(F.col("topic") == topic) if topic else paths
    valid = complete_members(rows, catalog.where("ingestible"))
    return valid.withColumn("unverified", F.col("quality") != "verified").orderBy("unverified", "title", "path_id")


def suggest(paths: DataFrame, catalog: DataFrame, query: str = "", topic: str | None = None, limit: int = 20) -> DataFrame:
    """Recommended valid pairs, then ranked datasets that the pairs do not already use."""
    available = catalog.where("ingestible")
    pairs = complete_members(match_paths(paths, query, topic), available)
    used = pairs.select(F.explode("resource_ids").alias("id"))
    text = f"{topic} {' '.join(tokenize(query))}" if topic else query
    ranked = rank_catalog(available, text).join(used.distinct(), "id", "left_anti")
    datasets = ranked.orderBy(F.desc("combined"), F.desc("quality"), F.desc("title"), "id").limit(limit)
    return pairs.select(
        F.lit("pair").alias("kind"), F.col("path_id").cast("string").alias("id"), "title", "score"
    ).unionByName(
        datasets.select(F.lit("dataset").alias("kind"), F.col("id").cast("string").alias("id"), "title", F.round("combined", 4).alias("score"))
    )
