import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from openstat.functions import text
from openstat.functions.pvalues import chi2_upper, t_two_sided
from openstat.operators import association, correlation, groups, narrative, ranks, trend
from openstat.operators.profile import TableProfile
from openstat.plans import analysis, test_queries
from openstat.plans.selection import PlanLimits, left_out, plan_tests


@pytest.mark.parametrize(
    "t, df, p",
    [(2.0, 10, 0.07338803477074048), (12.706204736, 1, 0.05), (0.0, 5, 1.0), (1.959963984540054, 1e9, 0.05), (-2.0, 10, 0.07338803477074048)],
)
def test_t_distribution(t, df, p):
    assert t_two_sided(t, df) == pytest.approx(p, rel=1e-8)


@pytest.mark.parametrize("x, df, p", [(3.841458820694124, 1, 0.05), (11.070497693516351, 5, 0.05), (0.0, 3, 1.0), (2.0, 2, math.exp(-1.0)), (700.0, 2, math.exp(-350.0))])
def test_chi_square_distribution(x, df, p):
    assert chi2_upper(x, df) == pytest.approx(p, rel=1e-8)


def test_tails_underflow_to_zero_only_at_the_end():
    assert 0 < t_two_sided(50, 200) < 1e-100
    assert t_two_sided(1e6, 1000) == 0.0
    assert chi2_upper(1e5, 2) == 0.0


def test_ranges_and_single_window_agree(spark):
    rng = np.random.default_rng(1)
    rows = [(d, float(v), int(n)) for d in "ab" for v, n in zip(rng.permutation(500), rng.integers(1, 9, 500))]
    counts = spark.createDataFrame(rows, "d string, value double, n long")
    one = {(r.d, r.value): r.before for r in ranks.rows_before(counts, ["d"]).collect()}
    many = {(r.d, r.value): r.before for r in ranks.rows_before(counts, ["d"], range_rows=7).collect()}
    assert one == many and len(one) == 1000
    whole = {r.value: r.before for r in ranks.rows_before(counts.where("d = 'a'"), [], range_rows=3).collect()}
    assert whole == {v: b for (d, v), b in one.items() if d == "a"}


def test_quantiles_match_linear_interpolation(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(size=701), 2)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    row = ranks.quantiles(df, "v", {"a": 0.02, "b": 0.5, "c": 0.9}).first()
    assert [row.a, row.b, row.c] == pytest.approx(np.quantile(values, [0.02, 0.5, 0.9]).tolist())


def test_spearman_with_nulls_and_a_hot_value(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random(600) < 0.4, 5.0, rng.integers(0, 50, 600)).astype(float)
    y = x * 2 + rng.normal(size=600) * 20
    gaps = [None if i % 7 == 0 else float(v) for i, v in enumerate(y)]
    df = spark.createDataFrame([(float(a), float(b), c) for a, b, c in zip(x, y, gaps)], "x double, y double, z double")

    def mean_ranks(v):
        order = np.sort(v)
        return (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2

    got = {(r.col_a, r.col_b): (r.r, r.n) for r in correlation.spearman_pairs(df, ["x", "y", "z"]).collect()}
    assert got["x", "y"][0] == pytest.approx(np.corrcoef(mean_ranks(x), mean_ranks(y))[0, 1])
    keep = np.array([g is not None for g in gaps])
    assert got["x", "z"][0] == pytest.approx(np.corrcoef(mean_ranks(x[keep]), mean_ranks(y[keep]))[0, 1])
    assert got["x", "z"][1] == int(keep.sum())


def test_spearman_of_many_columns_with_nulls_everywhere(spark):
    """Every pair over its own rows, in two moves of the rows whatever the number of columns."""
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(300, 14)) + rng.normal(size=(300, 1)), 1)
    x[:, 13] = 4.0
    empty = rng.random((300, 14)) < 0.15
    empty[:, 3] = False
    empty[:, 5] = empty[:, 6]
    names = [f"c {i}" for i in range(14)]
    data = [tuple(None if e else float(v) for v, e in zip(r, m)) for r, m in zip(x, empty)]
    df = spark.createDataFrame(data, ", ".join(f"`{n}` double" for n in names)).repartition(3)
    pairs = correlation.spearman_pairs(df, names)
    got = {(r.col_a, r.col_b): (r.r, r.n) for r in pairs.collect()}

    def mean_ranks(v):
        order = np.sort(v)
        return (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2

    assert len(got) == 91
    for i in range(14):
        for j in range(i + 1, 14):
            keep = ~empty[:, i] & ~empty[:, j]
            r, n = got[names[i], names[j]]
            assert n == keep.sum()
            assert r is None if j == 13 else r == pytest.approx(np.corrcoef(mean_ranks(x[keep, i]), mean_ranks(x[keep, j]))[0, 1])


def test_limits_are_told(spark):
    profile = TableProfile("T", "t", 300, [{"name": f"m{i}", "kind": "numeric"} for i in range(14)] + [{"name": "g", "kind": "categorical"}])
    assert [len(p.columns) for p in plan_tests(profile).plans if p.kind == "correlation"] == [12]
    wide = PlanLimits(correlated=14, modeled=14, grouped=14, trended=14, plans=99)
    assert [len(p.columns) for p in plan_tests(profile, limits=wide).plans if p.kind == "correlation"] == [14]
    notes = left_out(profile, PlanLimits())
    assert "T: 12 of 14 numeric columns are correlated" in notes and left_out(profile, wide) == []


def test_two_groups_use_welch_and_small_groups_are_left_out(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [11.0, 12.0, 14.0, 17.0, 18.0, 22.0]
    rows = [("a", v) for v in a] + [("b", v) for v in b] + [("tiny", 900.0), ("tiny", 901.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    r = groups.group_tests(df, [("v", "g")]).first()
    va, vb = np.var(a, ddof=1) / 6, np.var(b, ddof=1) / 6
    t = (np.mean(a) - np.mean(b)) / math.sqrt(va + vb)
    assert r.method == "welch_t" and r.statistic == pytest.approx(t)
    assert r.df == pytest.approx((va + vb) ** 2 / (va**2 / 5 + vb**2 / 5))
    assert r.n == 14 and r.std == pytest.approx(np.std(a + b + [900.0, 901.0], ddof=1))
    assert r.highest_group == "b" and r.lowest_group == "a"


def test_perfect_correlation_scores_as_its_effect(spark):
    df = spark.createDataFrame([(float(i), float(i * 3)) for i in range(30)], "x double, y double")
    r = correlation.spearman_findings(df, ["x", "y"], "d", "D").first()
    assert (r.value, r.p_value, r.score) == (1.0, 0.0, 1.0)


def test_yates_applies_to_two_by_two_only(spark):
    rows = [("a", "x")] * 12 + [("a", "y")] * 8 + [("b", "x")] * 6 + [("b", "y")] * 14
    df = spark.createDataFrame(rows, "p string, q string")
    r = association.chi_square(association.crosstab(df, "p", "q")).first()
    assert r.chi2 == pytest.approx(40 * (abs(12 * 14 - 8 * 6) - 20) ** 2 / (20 * 20 * 18 * 22))
    assert r.df == 1 and r.min_cell == 6


def test_too_many_levels_give_no_table(spark):
    df = spark.createDataFrame([(str(i % 25), str(i % 2)) for i in range(200)], "p string, q string")
    assert association.crosstab(df, "p", "q").count() == 0
    assert association.chi_square_findings(df, "p", "q", "d", "D").count() == 0


def test_trend_averages_repeated_times(spark):
    rows = [(f"20{10 + i % 12:02d}-01-01 00:00:00", float(i % 12) * 5 + (i // 12)) for i in range(48)]
    df = spark.createDataFrame(rows, "t string, v double").selectExpr("cast(t as timestamp) as t", "v")
    r = trend.trend_findings(df, [("v", "t")], "d", "D").first()
    assert r.n == 12 and r.value > 0.99 and "upward" in r.title


def test_group_moments_rank_only_the_largest_levels(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 1000, "hot").otherwise(F.concat(F.lit("l"), F.pmod("id", F.lit(400)))).alias("g"),
        F.col("id").alias("m"),
    )
    moments = groups.group_moments(groups.long_form(rows, [("m", "g")]))
    assert moments._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 1
    got = moments.orderBy("size_rank").collect()
    assert len(got) == 12 and got[0].level == "hot" and {r.n_all for r in got} == {3000}
    assert [r.level for r in got[1:]] == sorted(f"l{i}" for i in range(400))[:11]


def _finding(kind, columns=("price", "kind"), value=None, n=40, title="Some title (of it)", **details):
    return (kind, list(columns), value, n, json.dumps(details), title)


def test_sentences_follow_type_and_case(spark):
    means = {"a": 1234.0, "b": 0.5}
    findings = [
        _finding("group_comparison", highest_group="a", lowest_group="b", group_means=means),
        _finding("group_comparison"),
        _finding("group_comparison", columns=("price",)),
        _finding("spearman_correlation", value=-0.8, direction="negative"),
        _finding("spearman_correlation", direction="negative"),
        _finding("time_trend", columns=("size",), direction="downward"),
        _finding("descriptive", columns=(), top_values="x"),
        _finding("unheard_of", columns=(), median="3"),
    ]
    schema = "type string, columns array<string>, value double, n long, details string, title string"
    rows = narrative.with_parts(spark.createDataFrame(findings, schema).coalesce(1)).select(
        narrative.headline(), narrative.impact(), narrative.plain_line()
    ).collect()
    assert [tuple(r) for r in rows[:1]] == [(
        "Price differs across Kind",
        "Average Price is highest for a ($1,234) and lowest for b ($0.5) across kinds in this sample.",
        "Price is not the same everywhere — a stands out as higher and b as lower when grouped by kind.",
    )]
    assert rows[1][1].startswith("Price is not uniform across kinds") and rows[1][2] == "Price varies noticeably depending on kind."
    assert tuple(rows[2]) == ("Some title", None, "Some title (of it)")
    assert rows[3][0] == "Strong negative association: Price and Kind (Spearman r = -0.8, n = 40)"
    assert rows[3][1] == "When Price rises, Kind tends to fall (Spearman r = -0.8) across 40 paired observations."
    assert rows[4][0] == "Price and Kind move in opposite directions"
    assert rows[5][1] == "Size generally decreased over the time period covered by this data."
    assert rows[6][1] == "Overview of the most common values in this dataset."
    assert tuple(rows[7]) == ("Some title", None, "Some title (of it)")


def test_grounded_numbers_against_the_plain_rule(spark):
    rng = random.Random(5)
    cases = []
    for _ in range(600):
        allowed = [rng.choice([rng.uniform(-2, 2), rng.uniform(-400, 400), float(rng.randint(-90, 90))]) for _ in range(2)]
        near = rng.choice(allowed) * rng.choice([1, 100]) * rng.uniform(0.985, 1.015) + rng.choice([0, rng.uniform(-0.6, 0.6)])
        cases.append((f"about {near:.3f} of it", allowed, float(f"{near:.3f}")))

    def close(x, y):
        return abs(x - y) <= 0.01 * max(abs(x), abs(y), 1) or (abs(round(x) - x) < 0.01 and abs(round(x) - y) < 0.5)

    def grounded(allowed, y):
        given = [*allowed, *map(float, range(1, 26))]
        shares = [round(100 * v, 4) for v in given if 0 < abs(v) <= 1.01]
        return any(close(x, y) for x in [*given, *shares, *map(abs, shares)])

    df = spark.createDataFrame([c[:2] for c in cases], "s string, a array<double>").coalesce(1)
    got = [r[0] for r in df.select(text.numbers_grounded(F.col("s"), F.col("a"))).collect()]
    read = [r[0] for r in df.select(text.numbers_in(F.col("s"))).collect()]
    expected = [all(grounded(c[1], y) for y in numbers) for c, numbers in zip(cases, read)]
    assert got == expected and 0 < sum(got) < len(got)


def test_kruskal_is_the_same_over_many_ranges(spark, monkeypatch):
    rng = np.random.default_rng(8)
    kind, value = rng.integers(0, 4, 600), np.where(rng.random(600) < 0.4, 5.0, rng.normal(5, 2, 600).round(1))
    df = spark.createDataFrame([("abcd"[k], float(v + k / 4)) for k, v in zip(kind, value)], "kind string, value double")
    rows = groups.long_form(df, [("value", "kind")])
    one = groups.kruskal(rows, groups.group_moments(rows)).first()
    seen = []
    place = groups._in_ranges
    monkeypatch.setattr(groups, "RANGE_ROWS", 40)
    monkeypatch.setattr(groups, "_in_ranges", lambda *a: seen.append(place(*a)) or seen[-1])
    many = groups.kruskal(rows, groups.group_moments(rows)).first()
    assert seen[0].select("range").distinct().count() > 5
    values = pd.Series([v + k / 4 for k, v in zip(kind, value)])
    rank, n = values.rank(), len(values)
    ties = values.value_counts().astype(float)
    raw = 12 / (n * (n + 1)) * sum(rank[kind == k].sum() ** 2 / (kind == k).sum() for k in range(4)) - 3 * (n + 1)
    want = raw / (1 - (ties**3 - ties).sum() / (n**3 - n))
    assert one["statistic"] == pytest.approx(want) and many["statistic"] == pytest.approx(want) and many["df"] == 3.0


def test_overlaps_compare_rows_only_where_columns_have_nulls(spark, monkeypatch):
    rows = [(float(i), float(i % 3), None if i % 4 == 0 else float("nan"), float(i) if i % 5 else None, None) for i in range(40)]
    df = spark.createDataFrame(rows, "x0 double, x1 double, x2 double, x3 double, x4 double").repartition(3)
    want = [[sum(r[i] is not None and r[j] is not None for r in rows) for j in range(5)] for i in range(5)]
    assert correlation._overlaps(df).tolist() == want
    assert correlation._overlaps(df.limit(0)).tolist() == [[0] * 5] * 5
    monkeypatch.setattr(type(df), "mapInArrow", None)  # no pass over the rows in Python
    assert correlation._overlaps(df.select("x0", "x1", "x2")).tolist() == [r[:3] for r in want[:3]]


def test_two_table_analysis_sums_the_lines_of_orders_once(spark, tmp_path, monkeypatch):
    spark.range(60).selectExpr("id % 20 AS l_orderkey", "id * 1.5D AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(20).selectExpr(
        "id AS o_orderkey", "id * 2.0D AS o_totalprice", "concat(id % 3, '-X') AS o_orderpriority"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    seen = []
    monkeypatch.setattr(test_queries.analysis, "analyze", lambda tables, *a, whole=analysis.analyze, **b: seen.extend(tables) or whole(tables, *a, **b))
    test_queries.analyze_two_tables(spark, str(tmp_path))
    lines = seen[0]
    assert not any("lineitem" in f for f in lines.inputFiles())  # each reading would sum them up again
    assert sorted(map(tuple, lines.collect())) == [(i, 3, round(1.5 * (3 * i + 60), 2)) for i in range(20)]
