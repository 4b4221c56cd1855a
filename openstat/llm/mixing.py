"""Mixing sources to target weights by budgets down a tree.

The token budget flows from the root through the levels (domain, language, source).
Each node splits its budget over its children by weight; a child that cannot fill
its share keeps what it has, and its shortage goes to its siblings, and only past
them, because a subtree never takes more than it holds, to other branches.

A leaf with budget above its tokens repeats them in whole epochs, and takes from
the last epoch the longest prefix, in that epoch's seeded order, that fits.
Null counts as the path value "null". A value that `weights` does not name under its
node, null included, belongs to the node's child OTHER; all such values share that
child's weight. Documents whose path has no positive weight, by a weight of 0 or
because the node has no OTHER, are left out; documents without words cost nothing
and go with the prefix.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from openstat.session import store

Path = tuple[str, ...]
RANGES = 4096
#: Stands for all values of a level that are not named under their node.
OTHER = "*"


def shares(budget: int, weights: list[float], room: list[int]) -> list[int]:
    """Split a whole-number budget by weight, no child above its room.

    Full children drop out and the others share on. Rounding goes to the largest
    remainders, ties to the first child.
    """
    got, open_, left = [0] * len(weights), [i for i, w in enumerate(weights) if w > 0], budget
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] >= total * room[i]]
        if full:
            for i in full:
                got[i] = room[i]
            left = budget - sum(got)
            open_ = [i for i in open_ if i not in full]
            continue
        exact = {i: left * weights[i] / total for i in open_}
        for i in open_:
            got[i] = int(exact[i])
        rest = left - sum(int(exact[i]) for i in open_)
        for i in sorted(open_, key=lambda i: (int(exact[i]) - exact[i], i))[:rest]:
            got[i] += got[i] < room[i]
        break
    return got


def leaf_budgets(
    weights: Mapping[Path, float], tokens: Mapping[Path, int], budget: int, epochs: int
) -> dict[Path, int]:
    """Budget of each leaf. `weights` names every node by its path; paths without one weigh 0."""
    room: dict[Path, int] = {}
    for leaf, n in tokens.items():
        if all(weights.get(leaf[: d + 1], 0) > 0 for d in range(len(leaf))):
            for d in range(len(leaf) + 1):
                room[leaf[:d]] = room.get(leaf[:d], 0) + n * epochs
    out: dict[Path, int] = {}

    def fill(node: Path, amount: int) -> None:
        children = sorted(p for p in room if len(p) == len(node) + 1 and p[: len(node)] == node)
        if not children:
            out[node] = amount
            return
        for child, part in zip(
            children, shares(amount, [weights[c] for c in children], [room[c] for c in children])
        ):
            fill(child, part)

    if room:
        fill((), min(budget, room[()]))
    return out


def _named(rows: DataFrame, names: list[str], weights: Mapping[Path, float]) -> DataFrame:
    """Path values that `weights` does not name under their node, as OTHER."""
    if not any(OTHER in p for p in weights):
        return rows
    for d, name in enumerate(names):
        keys = names[: d + 1]
        known = rows.sparkSession.createDataFrame(
            [(*p, True) for p in weights if len(p) == d + 1], ", ".join(f"{n} string" for n in keys) + ", _known boolean"
        )
        rows = rows.join(F.broadcast(known), keys, "left").withColumn(
            name, F.when(F.col("_known"), F.col(name)).otherwise(F.lit(OTHER))
        ).drop("_known")
    return rows


def mix_sources(
    docs: DataFrame, path: Mapping[str, Column], weights: Mapping[Path, float], tokens: Column,
    id_col: str = "doc_id", text_col: str = "text", budget: int | None = None,
    share: float = 1.0, epochs: int = 1, seed: int = 7,
) -> DataFrame:
    """Selected rows of `docs` with n_tokens and copies (at least 1).

    `budget` counts tokens; None means `share` of all tokens of weighted leaves. The
    driver sees one total per leaf named in `weights`. The prefix cut comes from
    totals over 4 096 ranges of the seeded order; single rows are ordered only in
    the range that holds a leaf's cut. Columns named n_tokens or copies are replaced.
    """
    levels = list(path)
    spark = docs.sparkSession
    names = [f"_level_{n}" for n in levels]
    rows = docs.drop(*({"n_tokens", "copies"} - {id_col, text_col})).withColumns(
        {n: F.coalesce(path[k].cast("string"), F.lit("null")) for n, k in zip(names, levels)}
        | {"n_tokens": F.coalesce(tokens, F.lit(0)).cast("long")}
    )
    rows = _named(rows, names, weights)
    leaves = [(*p, float(w)) for p, w in weights.items() if len(p) == len(levels) and w > 0]
    named = spark.createDataFrame(
        [p[:-1] for p in leaves], ", ".join(f"{n} string" for n in names)
    )
    totals = (
        rows.groupBy(*names).agg(F.sum("n_tokens").alias("n"))
        .join(F.broadcast(named), names, "left_semi")
    )
    held = {tuple(r[:-1]): int(r[-1]) for r in totals.collect()}
    whole = sum(
        n for p, n in held.items() if all(weights.get(p[: d + 1], 0) > 0 for d in range(len(p)))
    )
    given = leaf_budgets(weights, held, int(whole * share) if budget is None else budget, epochs)
    plan = spark.createDataFrame(
        [
            (*p, amount // max(held[p], 1), amount % max(held[p], 1) if held[p] else 0)
            for p, amount in given.items()
        ],
        ", ".join(f"{n} string" for n in names) + ", _whole long, _rest long",
    )
    order = F.xxhash64(F.lit(seed), F.col("_whole"), F.col(id_col).cast("string"), F.col(text_col))
    ranked = rows.join(F.broadcast(plan), names).withColumns(
        {"_order": order, "_range": F.shiftrightunsigned(order, 64 - RANGES.bit_length() + 1).cast("int")}
    )
    upto = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = (
        ranked.groupBy(*names, "_range", "_rest").agg(F.sum("n_tokens").alias("_n"))
        .withColumn("_end", F.sum("_n").over(upto))
        .filter("_end > _rest")
        .groupBy(*names).agg(F.min(F.struct("_range", "_end", "_n")).alias("_cut"))
        .select(*names, F.col("_cut._range").alias("_at"), (F.col("_cut._end") - F.col("_cut._n")).alias("_base"))
    )
    cuts = store(ranges)
    marked = ranked.join(F.broadcast(cuts), names, "left")
    running = (
        Window.partitionBy(*names).orderBy("_order", id_col, text_col)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    inside = marked.filter("_range = _at").withColumn(
        "_extra", (F.col("_base") + F.sum("n_tokens").over(running) <= F.col("_rest")).cast("int")
    )
    outside = marked.filter("_at is null or _range <> _at").withColumn(
        "_extra", F.coalesce((F.col("_range") < F.col("_at")).cast("int"), F.lit(0))
    )
    return (
        inside.unionByName(outside)
        .withColumn("copies", (F.col("_whole") + F.col("_extra")).cast("int"))
        .filter("copies > 0")
        .drop(*names, "_whole", "_rest", "_order", "_range", "_at", "_base", "_extra")
    )
