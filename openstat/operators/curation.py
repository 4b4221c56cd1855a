"""Which catalog candidates to keep, discover, probe and index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from openstat import rules
from openstat.session import cut_lineage


def _first(rows: DataFrame, key: str, used: DataFrame, cap: int) -> DataFrame:
    """Rows among the first of their key that still fit under the cap after `used` (key, n).

    The rank is cut at the plain cap, so Spark trims every key per task before the
    shuffle; what is already used is taken off afterwards.
    """
    ranked = rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy("seq"))).where(F.col("__r") <= cap)
    room = F.col("__r") + F.coalesce("__n", F.lit(0)) <= cap
    taken = used.select(F.col(key).alias("__k"), F.col("n").alias("__n"))
    return ranked.join(taken, F.col(key).eqNullSafe(F.col("__k")), "left").where(room).drop("__r", "__n", "__k")


def _without_full(rows: DataFrame, key: str, used: DataFrame, cap: int) -> DataFrame:
    full = used.where(F.col("n") >= cap).select(F.col(key).alias("__k"))
    return rows.join(full, F.col(key).eqNullSafe(F.col("__k")), "left_anti")


def _count(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def diversity_caps(candidates: DataFrame, per_family: int = 2, per_topic: int = 250) -> DataFrame:
    """Candidates kept in arrival order under a family cap and a topic cap.

    Columns: id, family, topic, seq, curated. Curated rows are always kept and
    count toward both caps; the others come after them. When no family spans
    topics, the greedy walk equals two ranked filters. When one does, a refusal by
    topic frees a family slot: a row that fits both caps even if every earlier row
    still open is kept is certain, so each round takes the certain rows, closes the
    full families and topics, and goes on with the rest until none is open. The
    first open row is always certain, so the rounds end.
    """
    # a null family or topic is one group, as in a window
    curated, others = candidates.where("curated"), candidates.where("not coalesce(curated, false)")
    spans = (
        candidates.groupBy("family").agg((F.min("topic") < F.max("topic")).alias("s")).where("s").limit(1).count()
    )
    if not spans:
        of_family = _first(others, "family", _count(curated, "family"), per_family)
        return curated.unionByName(_first(of_family, "topic", _count(curated, "topic"), per_topic).select(*candidates.columns))
    # later rows of a (family, topic) pair never outlive its first ones
    pair = W.partitionBy("family", "topic").orderBy("seq")
    open_rows = cut_lineage(
        others.withColumn("__r", F.row_number().over(pair)).where(F.col("__r") <= per_family).drop("__r")
        .withColumn("__row", F.monotonically_increasing_id())
    )
    kept = cut_lineage(curated)
    while True:
        families, topics = _count(kept, "family"), _count(kept, "topic")
        live = cut_lineage(
            _without_full(_without_full(open_rows, "family", families, per_family), "topic", topics, per_topic)
        )
        certain = _first(live, "family", families, per_family).join(
            _first(live, "topic", topics, per_topic).select("__row"), "__row", "left_semi"
        )
        taken = cut_lineage(certain)
        if not taken.limit(1).count():
            return kept
        kept = cut_lineage(kept.unionByName(taken.select(*candidates.columns)))
        open_rows = live.join(taken.select("__row"), "__row", "left_anti")


def discovery_pool(limit: int, seeds: int) -> int:
    return min(max(4 * limit, limit + seeds), 1000)


def newest_candidates(sources: list[DataFrame], limit: int, seeds: int) -> DataFrame:
    """(id, recency): latest time per id over all sources, newest first, up to the pool size."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    newest = every.where("id is not null").groupBy("id").agg(F.max("recency").alias("recency"))
    return newest.orderBy(F.desc("recency"), "id").limit(discovery_pool(limit, seeds))


def meaningful_views(views: DataFrame) -> DataFrame:
    """Visible, titled, tabular views with at least two scalar columns.

    Columns: view_type, title, hide_from_catalog, hide_from_data, scalar_columns.
    """
    kind = F.lower(F.coalesce("view_type", F.lit("tabular")))
    hidden = F.coalesce("hide_from_catalog", F.lit(False)) | F.coalesce("hide_from_data", F.lit(False))
    return views.where(
        ~hidden & ~kind.isin(*rules.SKIP_VIEW_TYPES)
        & (F.trim(F.coalesce("title", F.lit(""))) != "") & (F.col("scalar_columns") >= 2)
    )


def probe_batch(catalog: DataFrame, limit: int = 500) -> DataFrame:
    """Oldest rows still waiting for a probe."""
    waiting = ~F.coalesce("ingestible", F.lit(False)) & F.col("ingest_block_reason").isin(
        "pending probe", "no distribution URL"
    )
    return catalog.where(waiting).orderBy("updated_at", "id").limit(limit)


def sync_budget(rows: DataFrame, ingestible_cap: int, index_cap: int, would_pass: Column) -> DataFrame:
    """Index rows in arrival order up to a cap; probe while ingestible ones are below theirs.

    A row is probed when fewer than `ingestible_cap` earlier rows passed, that is,
    up to the row where the last free slot is taken. Both cut-offs are top-k reads.
    """
    indexed = rows.orderBy("seq").limit(index_cap)
    passing = indexed.where(would_pass).orderBy("seq").limit(ingestible_cap)
    last = passing.agg(
        F.when(F.count(F.lit(1)) >= ingestible_cap, F.max("seq"))
    ).scalar()
    probed = F.coalesce(F.col("seq") <= last, F.lit(True))
    passed = probed & would_pass
    return indexed.withColumn("probed", probed).withColumn("ingestible", passed).withColumn(
        "ingest_block_reason",
        F.when(~F.col("probed"), "pending probe").when(~F.col("ingestible"), F.lit("not ingestible")),
    )
