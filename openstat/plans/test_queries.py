"""Registered queries: statistical tests, their findings, ranking, charts and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from openstat.functions import text
from openstat.functions.pvalues import chi2_pvalue, t_pvalue
from openstat.operators import association, charts, correlation, groups, narrative, ranking, scoring, trend
from openstat.plans import analysis, selection
from openstat.plans.registry import query
from openstat.plans.table_queries import MERGED_SQL, merged_panel
from openstat.session import cut_lineage, read_table as t, store


def _rank(x, over=""):
    part = f"PARTITION BY {over}, {x}" if over else f"PARTITION BY {x}"
    order = f"PARTITION BY {over} ORDER BY {x}" if over else f"ORDER BY {x}"
    return f"(rank() OVER ({order}) + (count(*) OVER ({part}) - 1) / 2.0)"


# --- correlation ---------------------------------------------------------------------


def _order_lines(spark, d):
    """Per order: lines, quantity and value; a null where an order has one line."""
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.sum("l_discount"), 2).alias("discount"),
    )
    return lines.withColumn("gap", F.when(F.col("n_lines") > 1, F.col("discount")))


_ORDER_LINES_SQL = """SELECT l_orderkey, count(*) AS n_lines, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price,
  round(sum(l_discount), 2) AS discount, CASE WHEN count(*) > 1 THEN round(sum(l_discount), 2) END AS gap FROM lineitem GROUP BY 1"""

_PAIR_COLUMNS = ["n_lines", "qty", "price", "discount", "gap"]


def _pairs_sql(source, columns):
    parts = []
    for i, a in enumerate(columns):
        for b in columns[i + 1:]:
            parts.append(
                f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(ra, rb), 8) AS r, count(*) AS n FROM (
                    SELECT {_rank(a)} AS ra, {_rank(b)} AS rb FROM s WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
            )
    return f"WITH s AS ({source}) " + " UNION ALL ".join(parts)


@query("spearman_pairs", _pairs_sql(_ORDER_LINES_SQL, _PAIR_COLUMNS))
def spearman_pairs(spark, d):
    rows = correlation.spearman_pairs(_order_lines(spark, d), _PAIR_COLUMNS)
    return rows.select("col_a", "col_b", F.round("r", 8).alias("r"), "n")


@query("spearman_lineitem", _pairs_sql("SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def spearman_lineitem(spark, d):
    rows = correlation.spearman_pairs(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rows.select("col_a", "col_b", F.round("r", 8).alias("r"), "n")


def _document_sizes(spark, d):
    """Words by spaces against characters: a pair that carries signal."""
    docs = t(spark, d, "documents")
    return docs.select("n_chars", (F.size(F.split("text", " ")) - 1).alias("spaces"))


_FINDING_SQL = f"""WITH s AS (SELECT n_chars, len(text) - len(replace(text, ' ', '')) AS spaces FROM documents),
  k AS (SELECT {_rank('n_chars')} AS ra, {_rank('spaces')} AS rb FROM s), c AS (SELECT corr(ra, rb) AS r, count(*) AS n FROM k)
  SELECT 'spearman_correlation' AS type, 'spaces and N chars tend to move together' AS title, round(r, 4) AS value, n FROM c
  WHERE n >= 8 AND abs(r) >= 0.3 AND abs(r) * sqrt((n - 2) / (1 - r * r)) > 6"""


@query("spearman_findings", _FINDING_SQL)
def spearman_findings(spark, d):
    """Far beyond any 5 % threshold here (t > 6), which SQL can check without a t distribution."""
    rows = correlation.spearman_findings(_document_sizes(spark, d), ["spaces", "n_chars"], "documents", "Documents")
    return rows.select("type", "title", "value", "n")


_VIEWS_SQL = f"""WITH m AS ({MERGED_SQL}),
  v AS (SELECT 'panel_pooled' AS view, value_a, value_b FROM m
        UNION ALL SELECT 'cross_section_latest', value_a, value_b FROM m WHERE year = (SELECT max(year) FROM m)
        UNION ALL SELECT 'country_means', avg(value_a), avg(value_b) FROM m GROUP BY entity_id)
  SELECT view, count(*) AS n, round(corr(ra, rb), 6) AS r FROM (
    SELECT view, {_rank('value_a', 'view')} AS ra, {_rank('value_b', 'view')} AS rb FROM v) GROUP BY view"""


@query("cross_measure_views", _VIEWS_SQL)
def cross_measure_views(spark, d):
    merged = cut_lineage(merged_panel(spark, d))
    return correlation.spearman_by_view(correlation.panel_views(merged)).select("view", "n", F.round("r", 6).alias("r"))


@query("cross_measure_findings")
def cross_measure_findings(spark, d):
    """Order value against its own shifted copy: a related pair that passes the gates."""
    merged = cut_lineage(
        merged_panel(spark, d).withColumn("value_b", F.round(F.col("value_b") + F.col("value_a"), 4))
    )
    return correlation.cross_measure_findings(
        merged, "Order value", "Combined value", "order_value", "combined_value", "a+b", "country_year"
    )


# --- groups ----------------------------------------------------------------------------


def _shifted_orders(spark, d):
    shift = F.substring("o_orderpriority", 1, 1).try_cast("int") * 20_000
    return t(spark, d, "orders").select(
        "o_orderstatus", "o_orderpriority", "o_totalprice",
        (F.col("o_totalprice") + shift).alias("shifted"),
        F.when(F.month("o_orderdate") <= 6, "first half").otherwise("second half").alias("half"),
        (F.col("o_custkey") % 40).cast("string").alias("segment"),
    )


_SHIFTED_SQL = """SELECT o_orderstatus, o_orderpriority, o_totalprice, o_totalprice + left(o_orderpriority, 1)::INT * 20000 AS shifted,
  CASE WHEN month(o_orderdate) <= 6 THEN 'first half' ELSE 'second half' END AS half, (o_custkey % 40)::VARCHAR AS segment FROM orders"""

_GROUP_PLANS = [
    ("o_totalprice", "half"), ("shifted", "half"), ("o_totalprice", "o_orderpriority"),
    ("shifted", "o_orderpriority"), ("shifted", "o_orderstatus"), ("o_totalprice", "segment"),
]


@query(
    "group_means",
    """WITH g AS (SELECT (o_custkey % 40)::VARCHAR AS level, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1),
       k AS (SELECT *, row_number() OVER (ORDER BY n DESC, level) AS r FROM g) SELECT level, n, mean FROM k WHERE r <= 12 AND n >= 3""",
)
def group_means(spark, d):
    rows = groups.group_means(_shifted_orders(spark, d), "o_totalprice", "segment")
    return rows.select("level", "n", F.round("mean", 4).alias("mean"))


_LONG_SQL = f"WITH s AS ({_SHIFTED_SQL}), long AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS measure, '{g}' AS factor, {g} AS level, {m} AS value FROM s" for m, g in _GROUP_PLANS
) + """), g AS (SELECT measure, factor, level, count(*) AS n, avg(value) AS mean, var_samp(value) AS var FROM long GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY measure, factor ORDER BY n DESC, level) AS sr FROM g),
  kept AS (SELECT *, n >= 3 AS tested FROM k WHERE sr <= 12)"""


@query(
    "welch_t",
    _LONG_SQL + """, w AS (SELECT measure, factor, count(*) AS c, arg_min(mean, level) - arg_max(mean, level) AS diff, sum(var / n) AS e2, sum((var / n) * (var / n) / (n - 1)) AS e4 FROM kept WHERE tested GROUP BY ALL)
       SELECT measure, factor, round(diff / sqrt(e2), 6) AS t, round(e2 * e2 / e4, 4) AS df FROM w WHERE c = 2""",
)
def welch_t(spark, d):
    rows = groups.welch(groups.group_moments(groups.long_form(_shifted_orders(spark, d), _GROUP_PLANS)))
    return rows.select("measure", "factor", F.round("statistic", 6).alias("t"), F.round("df", 4).alias("df"))


_KRUSKAL_SQL = _LONG_SQL + f""", c AS (SELECT measure, factor, count(*) AS c FROM kept WHERE tested GROUP BY ALL),
  r AS (SELECT l.measure, l.factor, l.level, l.value, c.c AS k, {_rank('l.value', 'l.measure, l.factor')} AS rk FROM long l
        JOIN kept ON kept.measure = l.measure AND kept.factor = l.factor AND kept.level = l.level AND kept.tested
        JOIN c ON c.measure = l.measure AND c.factor = l.factor WHERE c.c >= 3),
  q AS (SELECT measure, factor, k, sum(n) AS n, sum(s * s / n) AS q FROM (SELECT measure, factor, k, level, count(*) AS n, sum(rk) AS s FROM r GROUP BY ALL) GROUP BY ALL),
  tie AS (SELECT measure, factor, sum(t * t * t - t) AS tie FROM (SELECT measure, factor, value, count(*)::DOUBLE AS t FROM r GROUP BY ALL) GROUP BY ALL)
  SELECT q.measure, q.factor, round((12.0 / (n * (n + 1)) * q - 3.0 * (n + 1)) / (1 - tie / (n::DOUBLE * n * n - n)), 4) AS h, (k - 1)::DOUBLE AS df FROM q JOIN tie ON q.measure = tie.measure AND q.factor = tie.factor"""


@query("kruskal_h", _KRUSKAL_SQL)
def kruskal_h(spark, d):
    rows = groups.long_form(_shifted_orders(spark, d), _GROUP_PLANS)
    out = groups.kruskal(rows, groups.group_moments(rows))
    return out.select("measure", "factor", F.round("statistic", 4).alias("h"), "df")


@query(
    "normalized_group_effect",
    _LONG_SQL + """, e AS (SELECT measure, factor, max(mean) - min(mean) AS effect FROM kept WHERE tested GROUP BY ALL),
       sd AS (SELECT l.measure, l.factor, stddev_samp(value) AS std, count(*) AS n FROM long l JOIN kept USING (measure, factor, level) GROUP BY ALL)
       SELECT measure, factor, round(effect, 4) AS effect, round(least(1.0, effect / (4 * std)), 8) AS normalized, sd.n FROM e JOIN sd USING (measure, factor)""",
)
def normalized_group_effect(spark, d):
    rows = groups.group_tests(_shifted_orders(spark, d), _GROUP_PLANS)
    return rows.select("measure", "factor", F.round("effect", 4).alias("effect"), F.round("normalized", 8).alias("normalized"), "n")


@query("group_findings")
def group_findings(spark, d):
    return groups.group_findings(_shifted_orders(spark, d), _GROUP_PLANS, "orders", "Orders")


@query("quality_by_length")
def quality_by_length(spark, d):
    """Welch test of document length by quality label: a pair without signal."""
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    return groups.group_tests(rows, [("n_chars", "quality")]).select("measure", "factor", "method", "statistic", "df", "p", "n")


# --- association -------------------------------------------------------------------------


@query(
    "crosstab",
    """WITH s AS (SELECT l_returnflag AS a, l_shipdate FROM lineitem), c AS (SELECT l_returnflag AS a, year(l_shipdate)::VARCHAR AS b, count(*) AS n FROM lineitem WHERE NOT (l_returnflag = 'A' AND year(l_shipdate) = 1996) GROUP BY ALL)
       SELECT x.a AS level_a, y.b AS level_b, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT a FROM c) x CROSS JOIN (SELECT DISTINCT b FROM c) y LEFT JOIN c ON c.a = x.a AND c.b = y.b""",
)
def crosstab(spark, d):
    rows = t(spark, d, "lineitem").select(
        "l_returnflag",
        F.when(~((F.col("l_returnflag") == "A") & (F.year("l_shipdate") == 1996)), F.year("l_shipdate")).alias("year"),
    )
    return association.crosstab(rows, "l_returnflag", "year")


def _chi_sql(source, a, b):
    return f"""WITH s AS ({source}), c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM s WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
      ra AS (SELECT a, sum(n) AS r FROM c GROUP BY a), cb AS (SELECT b, sum(n) AS k FROM c GROUP BY b), tot AS (SELECT sum(n) AS t, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM c),
      e AS (SELECT coalesce(n, 0) AS n, r * k / t AS e, t, ka, kb FROM ra CROSS JOIN cb CROSS JOIN tot LEFT JOIN c ON c.a = ra.a AND c.b = cb.b),
      x AS (SELECT sum(CASE WHEN (ka - 1) * (kb - 1) = 1 THEN (abs(n - e) - least(0.5, abs(n - e))) ** 2 ELSE (n - e) ** 2 END / e) AS chi2, max(t) AS t, max(ka) AS ka, max(kb) AS kb, min(n) AS min_cell FROM e)
      SELECT round(chi2, 6) AS chi2, ((ka - 1) * (kb - 1))::BIGINT AS df, t::BIGINT AS n, min_cell::BIGINT AS min_cell, round(sqrt(chi2 / (t * least(ka - 1, kb - 1))), 8) AS cramers_v FROM x"""


def _chi(df, a, b):
    return association.chi_square(association.crosstab(df, a, b)).select(
        F.round("chi2", 6).alias("chi2"), "df", "n", F.col("min_cell").cast("bigint").alias("min_cell"), F.round("cramers_v", 8).alias("cramers_v")
    )


@query("chi_square", _chi_sql("SELECT l_returnflag, l_linestatus FROM lineitem", "l_returnflag", "l_linestatus"))
def chi_square(spark, d):
    return _chi(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("chi_square_yates", _chi_sql("SELECT quality, toxic FROM labels", "quality", "toxic"))
def chi_square_yates(spark, d):
    return _chi(t(spark, d, "labels"), "quality", "toxic")


def _linked_flags(spark, d):
    return t(spark, d, "lineitem").select(
        "l_returnflag", F.when(F.col("l_quantity") + F.ascii("l_returnflag") > 105, "large").otherwise("small").alias("size")
    )


@query("chi_square_findings")
def chi_square_findings(spark, d):
    return association.chi_square_findings(_linked_flags(spark, d), "l_returnflag", "size", "lines", "Lines")


# --- trend ---------------------------------------------------------------------------------


def _trending_orders(spark, d):
    return t(spark, d, "orders").select(
        "o_orderdate", "o_totalprice", (F.col("o_totalprice") + 1000 * F.year("o_orderdate")).alias("rising")
    )


_TREND_SQL = """WITH s AS (SELECT epoch(o_orderdate) AS x, o_totalprice, o_totalprice + 1000 * year(o_orderdate) AS rising FROM orders),
  l AS (SELECT 'o_totalprice' AS measure, x, o_totalprice AS y FROM s UNION ALL SELECT 'rising', x, rising FROM s),
  d AS (SELECT measure, x, avg(y) AS y FROM l GROUP BY ALL)
  SELECT measure, 'o_orderdate' AS time, count(*) AS n, round(regr_slope(y, x) * 1e6, 6) AS slope_per_mega_second, round(corr(y, x), 8) AS r, TRUE AS aggregated FROM d GROUP BY measure"""


@query("trend_stats", _TREND_SQL)
def trend_stats(spark, d):
    rows = trend.trend_stats(_trending_orders(spark, d), [("o_totalprice", "o_orderdate"), ("rising", "o_orderdate")])
    return rows.select(
        "measure", "time", "n", F.round(F.col("slope") * 1e6, 6).alias("slope_per_mega_second"), F.round("r", 8).alias("r"), "aggregated"
    )


@query(
    "trend_mostly_distinct",
    """SELECT 'value' AS measure, 'ts' AS time, count(*) AS n, round(regr_slope(value, epoch(ts)) * 1e6, 6) AS slope_per_mega_second, round(corr(value, epoch(ts)), 8) AS r,
              count(DISTINCT ts) < count(*) AS aggregated FROM events""",
)
def trend_mostly_distinct(spark, d):
    """Nearly every event has its own time, so the rows are fitted as they are."""
    rows = trend.trend_stats(t(spark, d, "events"), [("value", "ts")])
    return rows.select(
        "measure", "time", "n", F.round(F.col("slope") * 1e6, 6).alias("slope_per_mega_second"), F.round("r", 8).alias("r"), "aggregated"
    )


@query("trend_findings")
def trend_findings(spark, d):
    return trend.trend_findings(
        _trending_orders(spark, d), [("o_totalprice", "o_orderdate"), ("rising", "o_orderdate")], "orders", "Orders"
    )


# --- p-values, score, plans -------------------------------------------------------------------


@query("p_values")
def p_values(spark, d):
    """Tail probabilities of one t and one chi-square statistic per supplier nation."""
    rows = t(spark, d, "supplier").groupBy("s_nationkey").agg(
        F.avg("s_acctbal").alias("m"), F.stddev_samp("s_acctbal").alias("s"), F.count(F.lit(1)).alias("n")
    ).where("n > 2 and s > 0")
    stat = F.col("m") / (F.col("s") / F.sqrt("n"))
    return rows.select(
        "s_nationkey", "n", stat.alias("t"), t_pvalue(stat, (F.col("n") - 1).cast("double")).alias("p_t"),
        chi2_pvalue(stat * stat, F.lit(1.0)).alias("p_chi2"),
    )


def _scored(spark, d):
    """Finding-shaped rows, one per order: type and columns from its codes, score from its value."""
    o = t(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "spearman_correlation").when(F.col("o_orderstatus") == "O", "group_comparison").otherwise("time_trend")
    second = F.when(F.col("o_orderkey") % 3 == 0, "country").otherwise(F.lower(F.substring("o_orderpriority", 3, 20)))
    cols = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.concat(F.lit("m"), (F.col("o_custkey") % 9).cast("string")), second)).otherwise(
        F.array(second, F.concat(F.lit("m"), (F.col("o_custkey") % 9).cast("string")))
    )
    p = (F.col("o_orderkey") % 1000) / 10_000.0
    return scoring.as_findings(
        o, type=kind, title=F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), columns=cols,
        value=F.col("o_totalprice"), p_value=p, n=F.col("o_orderkey"), method=F.lit("m"), datasets=F.array(F.lit("orders")),
        score=F.round(scoring.evidence_score(F.col("o_totalprice") / 1000, p), 8), details=F.lit("{}"),
    )


_SCORED_SQL = """SELECT CASE o_orderstatus WHEN 'F' THEN 'spearman_correlation' WHEN 'O' THEN 'group_comparison' ELSE 'time_trend' END AS type,
  'order ' || o_orderkey AS title, 'm' || (o_custkey % 9) AS c1, CASE WHEN o_orderkey % 3 = 0 THEN 'country' ELSE lower(substr(o_orderpriority, 3)) END AS c2,
  o_orderkey % 2 = 0 AS m_first, o_totalprice AS value, (o_orderkey % 1000) / 10000.0 AS p_value, o_orderkey AS n,
  round(CASE WHEN o_orderkey % 1000 = 0 THEN o_totalprice / 1000 ELSE o_totalprice / 1000 * least(20.0, -log10((o_orderkey % 1000) / 10000.0)) END, 8) AS score FROM orders"""


@query("evidence_scores", f"SELECT n, p_value, round(score, 4) AS score FROM ({_SCORED_SQL})")
def evidence_scores(spark, d):
    return _scored(spark, d).select("n", "p_value", F.round("score", 4).alias("score"))


_RANKED_SQL = f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY type, c1, c2 ORDER BY score DESC, title) AS r FROM ({_SCORED_SQL})) WHERE r = 1) WHERE rank <= 50"""


@query("rank_findings", f"SELECT 'f_' || rank AS id, rank, type, title, round(score, 4) AS score FROM ({_RANKED_SQL})")
def rank_findings(spark, d):
    return ranking.rank_findings(_scored(spark, d)).select(
        "id", F.col("rank").cast("bigint").alias("rank"), "type", "title", F.round("score", 4).alias("score")
    )


@query(
    "reweighted_scores",
    f"""SELECT n, round(score * CASE type WHEN 'spearman_correlation' THEN 2.5 WHEN 'group_comparison' THEN CASE WHEN c2 = 'country' AND m_first THEN 0.05 ELSE 1.0 END ELSE 0.6 END, 10) AS score FROM ({_SCORED_SQL})""",
)
def reweighted_scores(spark, d):
    return ranking.reweight(_scored(spark, d), True).select("n", F.round("score", 10).alias("score"))


_DISPLAY_SQL = f"""WITH k AS ({_RANKED_SQL}), a AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY rank) AS nth FROM k),
  s AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN nth <= 2 THEN 1 ELSE 2 END, rank) AS display_order FROM a)
  SELECT display_order, rank, type, title FROM s WHERE display_order <= 5"""


@query("display_findings", _DISPLAY_SQL)
def display_findings(spark, d):
    rows = ranking.choose_display(ranking.rank_findings(_scored(spark, d)))
    return rows.select(F.col("display_order").cast("bigint").alias("display_order"), F.col("rank").cast("bigint").alias("rank"), "type", "title")


@query(
    "display_findings_compare",
    f"""WITH k AS ({_RANKED_SQL}), l AS (SELECT min(rank) FILTER (type = 'spearman_correlation') AS lead FROM k),
        a AS (SELECT *, rank = lead AS is_lead, row_number() OVER (PARTITION BY type ORDER BY rank = lead DESC, rank) AS nth FROM k, l
              WHERE NOT (type = 'group_comparison' AND c2 = 'country' AND m_first)),
        s AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN is_lead THEN 0 WHEN nth <= 2 THEN 1 ELSE 2 END, rank) AS display_order FROM a)
        SELECT display_order, rank, type, title FROM s WHERE display_order <= 5""",
)
def display_findings_compare(spark, d):
    rows = ranking.choose_display(ranking.rank_findings(_scored(spark, d)), compare=True)
    return rows.select(F.col("display_order").cast("bigint").alias("display_order"), F.col("rank").cast("bigint").alias("rank"), "type", "title")


@query("narrated_findings")
def narrated_findings(spark, d):
    ranked = cut_lineage(ranking.rank_findings(
        groups.group_findings(_shifted_orders(spark, d), _GROUP_PLANS, "orders", "Orders").unionByName(
            trend.trend_findings(_trending_orders(spark, d), [("rising", "o_orderdate")], "orders", "Orders")
        )
    ))
    return narrative.narrate(ranked).select("id", "title", "impact", "technical_line")


@query("summary_lines")
def summary_lines(spark, d):
    found = correlation.spearman_findings(_document_sizes(spark, d), ["spaces", "n_chars"], "a+b", "Documents", primary=True)
    ranked = cut_lineage(ranking.rank_findings(found))
    return narrative.summary_lines(ranked, ["Spaces", "Characters"])


@query(
    "confidence_labels",
    f"""SELECT CASE WHEN p_value < 0.001 THEN 'Very strong evidence' WHEN p_value < 0.01 THEN 'Strong evidence' WHEN p_value < 0.05 THEN 'Moderate evidence' END AS label,
               CASE WHEN p_value < 0.001 THEN '< 0.001' ELSE printf('%.3f', CASE WHEN p_value * 16 = floor(p_value * 16) THEN p_value + 1e-9 ELSE p_value END) END AS p_text, count(*) AS n FROM ({_SCORED_SQL}) GROUP BY ALL""",
)
def confidence_labels(spark, d):
    rows = _scored(spark, d).select(
        text.confidence_label(F.col("p_value")).alias("label"), text.format_p(F.col("p_value")).alias("p_text")
    )
    return rows.groupBy("label", "p_text").agg(F.count(F.lit(1)).alias("n"))


@query("test_plans")
def test_plans(spark, d):
    rows = []
    for n in ("orders", "lineitem", "part", "customer"):
        profile = analysis.profile_table(t(spark, d, n), n, n)
        for i, p in enumerate(selection.plan_tests(profile).plans):
            rows.append((n, i, p.kind, p.columns, p.tier))
    return spark.createDataFrame(rows, "table string, position int, kind string, columns array<string>, tier string")


@query("methods_run")
def methods_run(spark, d):
    profile = analysis.profile_table(t(spark, d, "orders"), "orders", "orders")
    labels = selection.methods_run(selection.plan_tests(profile).plans, selection.analysis_mode(2), True)
    return spark.createDataFrame(list(enumerate(labels)), "position int, method string")


# --- charts -----------------------------------------------------------------------------------


@query("scatter_rows", "SELECT least(1500, count(*)) AS n, TRUE AS complete FROM documents")
def scatter_rows(spark, d):
    points = charts.scatter_rows(_document_sizes(spark, d), "spaces", "n_chars")
    return points.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("complete"))


@query(
    "line_rows",
    "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, round(avg(o_totalprice), 8) AS value FROM orders GROUP BY o_orderdate",
)
def line_rows(spark, d):
    rows = charts.line_rows(t(spark, d, "orders"), "o_orderdate", "o_totalprice", averaged=True)
    return rows.select(F.date_format("time", "yyyy-MM-dd").alias("day"), F.round("value", 8).alias("value"))


@query(
    "bar_rows",
    """WITH m AS (SELECT p_brand AS level, avg(p_retailprice) AS mean_value FROM part GROUP BY 1)
       SELECT level, round(mean_value, 6) AS mean_value, (SELECT count(*) FROM m) AS total, ' (top 10 of ' || (SELECT count(*) FROM m) || ')' AS title_suffix
       FROM m ORDER BY mean_value DESC, level LIMIT 10""",
)
def bar_rows(spark, d):
    rows = charts.bar_rows(t(spark, d, "part"), "p_retailprice", "p_brand")
    return rows.select("level", F.round("mean_value", 6).alias("mean_value"), "total", "title_suffix")


@query("chart_choice")
def chart_choice(spark, d):
    display = ranking.choose_display(ranking.rank_findings(_scored(spark, d)), compare=True)
    return charts.choose_charts(display).select("chart_order", "chart_type", "title")


# --- whole analyses -----------------------------------------------------------------------------


@query("order_value_by_priority")
def order_value_by_priority(spark, d):
    return analysis.order_value_by_priority(spark, d)


@query("analyze_one_table")
def analyze_one_table(spark, d):
    orders = t(spark, d, "orders").select(
        "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice",
        (F.col("o_totalprice") + 20_000 * F.substring("o_orderpriority", 1, 1).try_cast("int")).alias("adjusted_amount"),
    )
    result = analysis.analyze([orders], ["Orders"], ["orders"], models=False)
    return result.display.select("display_order", "id", "type", "title", "value", "p_value", "n", "score")


@query("analyze_two_tables")
def analyze_two_tables(spark, d):
    lines = store(t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("amount")
    ))  # the analysis reads its tables several times
    orders = t(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), "o_orderpriority"
    )
    result = analysis.analyze([lines, orders], ["Order lines", "Order value"], ["lines", "orders"], models=False)
    return result.display.select("display_order", "id", "type", "title", "value", "p_value", "n", "score")
