"""Spearman correlation of column pairs and of harmonized panels."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from openstat import rules
from openstat.functions.pvalues import t_pvalue
from openstat.functions.text import column_label
from openstat.operators.ranks import average_ranks
from openstat.operators.scoring import as_findings, empty_findings, evidence_score
from openstat.session import cut_lineage


def _overlaps(numeric: DataFrame) -> np.ndarray:
    """Rows in which both of two columns are filled, for all pairs.

    A column without nulls leaves to another all rows that this has; only columns with
    nulls are compared row by row, in a second pass.
    """
    filled = numeric.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in numeric.columns]).first()
    own = np.array([filled[c] for c in numeric.columns], np.int64)
    out = np.minimum.outer(own, own)
    gaps = np.flatnonzero(own < filled["n"])
    k = len(gaps)
    if k < 2:
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            filled = np.stack([np.asarray(c.is_valid()) for c in batch.columns], axis=1).astype(float)
            total += filled.T @ filled
        i, j = np.indices((k, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel().astype(np.int64))], ["i", "j", "n"])

    some = numeric.select(*[numeric.columns[i] for i in gaps])
    sums = some.mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # a number per pair of columns
        out[gaps[r["i"]], gaps[r["j"]]] = r["n"]
    return out


def _domains(both: np.ndarray) -> dict[tuple[int, int], int]:
    """For (column, other column) the number of the set of rows over which the column is ranked.

    Columns with nulls in the same rows restrict a column alike, and a column without
    nulls where the other is filled is not restricted at all.
    """
    own = np.diag(both)
    alike = (both == own[:, None]) & (both == own[None, :])
    first = alike.argmax(axis=1)
    found: dict[tuple[int, int], int] = {}
    numbers: dict[tuple[int, int], int] = {}
    for a in range(len(own)):
        for b in range(len(own)):
            rows = (a, a) if both[a, b] == own[a] else (a, int(first[b]))
            found[a, b] = numbers.setdefault(rows, len(numbers))
    return found


def _cross_products(width: int):
    """Sums of products of the centered ranks of all pairs of domains, over rows sorted by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        held = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0)]
        for batch in batches:
            row, domain, rank = (np.r_[h, c.to_numpy(zero_copy_only=False)] for h, c in zip(held, batch.columns))
            if not len(row):
                continue
            cut = int(np.searchsorted(row, row[-1]))  # the last row may go on
            held = [row[cut:], domain[cut:], rank[cut:]]
            at = np.unique(row[:cut], return_inverse=True)[1]
            z = np.zeros((int(at.max(initial=-1)) + 1, width))
            z[at, domain[:cut]] = rank[:cut]
            total += z.T @ z
        z = np.zeros(width)
        z[held[1]] = held[2]
        total += np.outer(z, z)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "s"])

    return run


def spearman_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col_a, col_b, r, n) for all pairs, each over the rows where both are non-null.

    Whatever the number of columns, rows move twice: all values of all columns, in one long form
    (row, domain, value), to the ranks of their domain, and the ranks back to their rows,
    where one matrix product sums up every pair. A column has one domain for each
    pattern of nulls that it meets in another column. Equal values are one row before they are ranked.
    """
    numeric = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    both = _overlaps(numeric)
    domains = _domains(both)
    pairs = list(combinations(range(len(columns)), 2))
    wanted = {domains[p]: p for a, b in pairs for p in ((a, b), (b, a))}
    number = {d: i for i, d in enumerate(wanted)}
    means = F.lit([(float(both[a, b]) + 1) / 2 for a, b in wanted.values()]).cast("array<double>")
    cells = F.array(*[
        F.struct(F.lit(i).alias("domain"), F.when(F.col(f"x{b}").isNotNull(), F.col(f"x{a}")).alias("value"))
        for i, (a, b) in enumerate(wanted.values())
    ])
    numbered = numeric.withColumn("row", F.monotonically_increasing_id())  # before the cells are spread out
    listed = numbered.select("row", F.inline(cells)).where("value is not null")
    counts = listed.groupBy("domain", "value").agg(F.count(F.lit(1)).alias("n"))
    ranks = average_ranks(counts, ["domain"]).select("domain", "value", "rank")
    centered = F.col("rank") - F.element_at(means, F.col("domain") + 1)
    ranked = listed.join(ranks, ["domain", "value"]).select("row", "domain", centered.alias("rank"))
    products = ranked.repartition("row").sortWithinPartitions("row").mapInArrow(_cross_products(len(number)), "i long, j long, s double")
    sums = products.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # a number per pair of domains
    of = {(r["i"], r["j"]): r["s"] for r in sums}
    found = []
    for a, b in pairs:
        i, j = number[domains[a, b]], number[domains[b, a]]
        spread = of.get((i, i), 0.0) * of.get((j, j), 0.0)
        r = of.get((i, j), 0.0) / math.sqrt(spread) if spread > 0 else None
        found.append((columns[a], columns[b], r, int(both[a, b])))
    return df.sparkSession.createDataFrame(found, "col_a string, col_b string, r double, n long")


def with_p(pairs: DataFrame) -> DataFrame:
    t = F.when(F.abs("r") >= 1, F.lit(float("inf"))).otherwise(
        F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    )
    return pairs.withColumn("p", t_pvalue(t, (F.col("n") - 2).cast("double")))


def spearman_findings(
    df: DataFrame, columns: list[str], resource_id: str, title: str,
    labels: dict[str, str] | None = None, primary: bool = False,
) -> DataFrame:
    """Pairs with n >= 8, |r| >= .3 and p < .05 as findings, of all given columns."""
    if len(columns) < 2:
        return empty_findings(df.sparkSession)
    tested = with_p(spearman_pairs(df, columns).where((F.col("n") >= 8) & ~F.isnan("r") & F.col("r").isNotNull()))
    kept = tested.where((F.abs("r") >= rules.MIN_R) & (F.col("p") < rules.MAX_P))

    def label(c: str) -> Column:
        known = labels or {}
        out = column_label(F.col(c))
        for name, text in known.items():
            out = F.when(F.col(c) == name, F.lit(text)).otherwise(out)
        return out

    rows = kept.withColumns({"la": label("col_a"), "lb": label("col_b")})
    direction = F.when(F.col("r") > 0, "positive").otherwise("negative")
    return as_findings(
        rows,
        type=F.lit("spearman_correlation"),
        title=F.concat_ws(
            " ", "la", F.lit("and"), "lb",
            F.when(F.col("r") < 0, "move in opposite directions").otherwise("tend to move together"),
        ),
        columns=F.array("col_a", "col_b"),
        value=F.round("r", 4), p_value=F.round("p", 6), n=F.col("n"),
        method=F.lit("spearman"), caveat=F.lit("correlation is not causation"),
        sql=F.format_string(
            "SELECT `%s`, `%s` FROM data WHERE `%s` IS NOT NULL AND `%s` IS NOT NULL",
            "col_a", "col_b", "col_a", "col_b",
        ),
        datasets=F.array(F.lit(resource_id)),
        score=evidence_score(F.col("r"), F.col("p")),
        details=F.to_json(
            F.struct(
                F.lit(title).alias("dataset_title"), direction.alias("direction"),
                F.create_map("col_a", "la", "col_b", "lb").alias("column_labels"),
                F.lit(primary).alias("primary"),
            )
        ),
    )


def panel_views(merged: DataFrame) -> DataFrame:
    """(view, value_a, value_b): all rows, the latest year, and entity means, in one frame."""
    newest = merged.where(F.col("year") == merged.agg(F.max("year")).scalar())
    means = merged.groupBy("entity_id").agg(F.avg("value_a").alias("value_a"), F.avg("value_b").alias("value_b"))
    parts = [("panel_pooled", merged), ("cross_section_latest", newest), ("country_means", means)]
    return reduce(
        DataFrame.unionByName,
        [p.select(F.lit(v).alias("view"), "value_a", "value_b") for v, p in parts],
    )


def spearman_by_view(views: DataFrame, view: str = "view") -> DataFrame:
    """Spearman r, n and distinct values per view, all views in the same shuffles."""
    cells = cut_lineage(views.groupBy(view, "value_a", "value_b").agg(F.count(F.lit(1)).alias("n")))
    sides = cells.select(
        view, F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"value_{s}").alias("value"), F.col("n").alias("n")) for s in "ab"]))
    )
    ranks = average_ranks(sides.groupBy(view, "side", "value").agg(F.sum("n").alias("n")), [view, "side"])

    def ranked(s: str) -> DataFrame:
        return ranks.where(F.col("side") == s).select(view, F.col("value").alias(f"value_{s}"), F.col("rank").alias(f"rank_{s}"))

    joined = cells.join(ranked("a"), [view, "value_a"]).join(ranked("b"), [view, "value_b"])
    n, a, b = F.col("n"), F.col("rank_a"), F.col("rank_b")
    mean = (F.col("total") + 1) / 2.0  # mean rank is known in advance
    sums = joined.join(
        F.broadcast(cells.groupBy(view).agg(F.sum("n").alias("total"))), view  # one row per view
    ).groupBy(view).agg(
        F.sum("n").alias("n"),
        F.sum(n * (a - mean) * (b - mean)).alias("sab"),
        F.sum(n * (a - mean) * (a - mean)).alias("saa"),
        F.sum(n * (b - mean) * (b - mean)).alias("sbb"),
        F.min("value_a").alias("a0"), F.max("value_a").alias("a1"),
        F.min("value_b").alias("b0"), F.max("value_b").alias("b1"),
    )
    varies = (F.col("a0") < F.col("a1")) & (F.col("b0") < F.col("b1"))
    return sums.select(view, "n", F.when(varies, F.col("sab") / F.sqrt(F.col("saa") * F.col("sbb"))).alias("r"))


def cross_measure_findings(
    merged: DataFrame, label_a: str, label_b: str, col_a: str, col_b: str,
    resource_id: str, strategy: str,
) -> DataFrame:
    """Pooled (primary), latest-year and entity-mean correlations that pass the gates."""
    tested = with_p(spearman_by_view(panel_views(merged)).where("r is not null"))
    pooled = F.col("view") == "panel_pooled"
    kept = tested.where(
        (F.col("n") >= F.when(pooled, 8).otherwise(5))
        & (F.abs("r") >= rules.MIN_R) & (F.col("p") < rules.MAX_P)
    )
    direction = F.when(F.col("r") < 0, "negative").otherwise("positive")
    caveat = (
        F.when(F.col("view") == "cross_section_latest", "Based on the latest year only; correlation is not causation")
        .when(F.col("view") == "country_means", "Each point is a country average across available years; correlation is not causation")
        .otherwise("correlation is not causation")
    )
    return as_findings(
        kept,
        type=F.lit("spearman_correlation"),
        title=F.concat(
            F.lit(f"{label_a} and {label_b} "),
            F.when(F.col("r") < 0, "move in opposite directions").otherwise("tend to move together"),
        ),
        columns=F.array(F.lit(col_a), F.lit(col_b)),
        value=F.round("r", 4), p_value=F.round("p", 6), n=F.col("n"),
        method=F.lit("spearman"), caveat=caveat, sql=F.lit("merged panel"),
        datasets=F.array(F.lit(resource_id)),
        score=evidence_score(F.col("r"), F.col("p")) * F.when(pooled, 1.35).otherwise(1.0),
        details=F.to_json(
            F.struct(
                F.lit(f"{label_a} + {label_b}").alias("dataset_title"), direction.alias("direction"),
                F.create_map(F.lit(col_a), F.lit(label_a), F.lit(col_b), F.lit(label_b)).alias("column_labels"),
                F.lit(True).alias("cross_measure"), F.col("view").alias("correlation_view"),
                F.lit(strategy).alias("join_strategy"), pooled.alias("primary"),
            )
        ),
    )
