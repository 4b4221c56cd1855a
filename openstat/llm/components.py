"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from openstat.session import store


def _renamed(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links between the components (node, component) of their ends; a node without one stays."""
    a, b = names.toDF("a", "to_a"), names.toDF("b", "to_b")
    return links.join(a, "a", "left").join(b, "b", "left").select(
        F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b")
    )


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """node, component (its smallest node) for links (a, b), and for those behind earlier labels.

    Each round every node goes to the smallest of itself and its neighbours, and on to where
    that one goes, which halves the length of chains. Nodes that meet are one from then on:
    the links are renamed, those inside a component go, and it ends when none is left. Earlier
    labels are the start, so only links between their components take part.
    Tables of links and labels stay distributed; the driver sees a count per round.
    """
    rows = 2 * links.count()
    left = links.select("a", "b") if labels is None else _renamed(links.select("a", "b"), labels)
    left = left.union(left.select("b", "a"))
    while True:
        left = store(left.filter("a <> b").distinct(), rows)
        rows = left.count()
        if not rows:
            return left.toDF("node", "component") if labels is None else labels
        near = left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select(
            "node", F.least("node", "b").alias("near")
        )
        moved = store(near.join(near.toDF("near", "component"), "near").select("node", "component"), rows)
        if labels is None:
            labels = moved
        else:
            target = moved.toDF("component", "to")
            labels = store(
                labels.join(target, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
                .unionByName(moved.join(labels, "node", "left_anti")),
                labels.count() + rows,
            )
        left = _renamed(left, moved)
