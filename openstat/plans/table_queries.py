"""Registered queries: coercion, profiles, relevance, filters, samples, descriptions, joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from openstat import rules
from openstat.functions import text
from openstat.operators import coerce as co
from openstat.operators import descriptive, filters, joins, relevance, sampling
from openstat.operators import profile as pr
from openstat.plans.registry import query
from openstat.session import read_table as t

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _tables(spark, d, names=TABLES):
    return {n: t(spark, d, n) for n in names}


# --- predicates and coercion ------------------------------------------------------


@query(
    "guarded_filter",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty
       FROM lineitem WHERE l_quantity >= 10 and l_returnflag <> 'N' and l_discount < 0.05
       GROUP BY ALL""",
)
def guarded_filter(spark, d):
    rows = filters.guarded_filter(
        t(spark, d, "lineitem"), "l_quantity >= 10 and l_returnflag <> 'N' and l_discount < 0.05"
    )
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")
    )


def _text_orders(spark, d):
    """Orders as text, with gaps, a mixed column and a year column."""
    o = t(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("key_text"),
        F.when(F.col("o_orderkey") % 4 == 0, "n/a").otherwise(F.format_string("%.2f", "o_totalprice")).alias("price_text"),
        F.when(F.col("o_orderkey") % 3 != 0, "unknown").otherwise(F.format_string("%.2f", "o_totalprice")).alias("mixed_text"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderstatus").alias("status"),
    )


_TEXT_ORDERS_SQL = """
  SELECT o_orderkey::VARCHAR AS key_text,
         CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' ELSE printf('%.2f', o_totalprice) END AS price_text,
         CASE WHEN o_orderkey % 3 <> 0 THEN 'unknown' ELSE printf('%.2f', o_totalprice) END AS mixed_text,
         strftime(o_orderdate, '%Y-%m-%d') AS day_text, year(o_orderdate) AS year, o_orderstatus AS status
  FROM orders"""


@query(
    "coerce_columns",
    f"""WITH s AS ({_TEXT_ORDERS_SQL})
        SELECT status, strftime(make_date(year, 1, 1), '%Y-%m-%d') AS year_start,
               count(*) AS n, sum(key_text::DOUBLE) AS key_sum,
               round(sum(try_cast(price_text AS DOUBLE)), 2) AS price_sum,
               count(try_cast(price_text AS DOUBLE)) AS prices,
               count(nullif(mixed_text, 'unknown')) AS mixed_kept_as_text,
               strftime(max(day_text::DATE), '%Y-%m-%d') AS last_day
        FROM s GROUP BY ALL""",
)
def coerce_columns(spark, d):
    c = co.coerce(_text_orders(spark, d))
    return c.groupBy("status", F.date_format("year", "yyyy-MM-dd").alias("year_start")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("key_text").alias("key_sum"),
        F.round(F.sum("price_text"), 2).alias("price_sum"), F.count("price_text").alias("prices"),
        F.count(F.nullif(F.col("mixed_text"), F.lit("unknown"))).alias("mixed_kept_as_text"),
        F.date_format(F.max("day_text"), "yyyy-MM-dd").alias("last_day"),
    )


@query(
    "coerce_parse_rates",
    f"""WITH s AS ({_TEXT_ORDERS_SQL}), n AS (SELECT count(*) AS n FROM s)
        SELECT name, n, numbers, low, high FROM n, (
          SELECT 'key_text' AS name, count(try_cast(key_text AS DOUBLE)) AS numbers, min(try_cast(key_text AS DOUBLE)) AS low, max(try_cast(key_text AS DOUBLE)) AS high FROM s
          UNION ALL SELECT 'price_text', count(try_cast(price_text AS DOUBLE)), min(try_cast(price_text AS DOUBLE)), max(try_cast(price_text AS DOUBLE)) FROM s
          UNION ALL SELECT 'mixed_text', count(try_cast(mixed_text AS DOUBLE)), min(try_cast(mixed_text AS DOUBLE)), max(try_cast(mixed_text AS DOUBLE)) FROM s
          UNION ALL SELECT 'day_text', 0, NULL, NULL
          UNION ALL SELECT 'year', count(year), min(year)::DOUBLE, max(year)::DOUBLE FROM s
          UNION ALL SELECT 'status', count(try_cast(status AS DOUBLE)), min(try_cast(status AS DOUBLE)), max(try_cast(status AS DOUBLE)) FROM s)""",
)
def coerce_parse_rates(spark, d):
    return co.parse_rates(_text_orders(spark, d)).select("name", "n", "numbers", "low", "high")


# --- profile ------------------------------------------------------------------------


def _profile_sql(table, columns):
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, '{c}' AS name, count(DISTINCT {c}) AS nunique,
            round(100.0 * (count(*) - count({c})) / count(*), 6) AS null_pct, '{k}' AS base FROM {table}"""
        for c, k in columns
    )


_PROFILED = {
    "orders": [("o_orderkey", "num"), ("o_custkey", "num"), ("o_orderstatus", "text"), ("o_totalprice", "num"), ("o_orderdate", "time"), ("o_orderpriority", "text")],
    "part": [("p_partkey", "num"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"), ("p_size", "num"), ("p_retailprice", "num")],
    "lineitem": [("l_orderkey", "num"), ("l_partkey", "num"), ("l_suppkey", "num"), ("l_linenumber", "num"), ("l_quantity", "num"), ("l_extendedprice", "num"), ("l_discount", "num"), ("l_tax", "num"), ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "time")],
    "customer": [("c_custkey", "num"), ("c_name", "text"), ("c_nationkey", "num"), ("c_acctbal", "num"), ("c_mktsegment", "text")],
    "documents": [("doc_id", "num"), ("lang", "text"), ("source", "text"), ("n_chars", "num")],
}


@query(
    "profile_columns",
    f"""SELECT table_name, name, nunique, null_pct,
          CASE WHEN base = 'time' THEN 'datetime'
               WHEN base = 'num' THEN CASE WHEN nunique > 1 THEN 'numeric' ELSE 'other' END
               WHEN nunique BETWEEN 2 AND 50 THEN 'categorical' ELSE 'other' END AS kind
        FROM ({' UNION ALL '.join(_profile_sql(n, c) for n, c in _PROFILED.items())})""",
)
def profile_columns(spark, d):
    parts = [
        pr.profile_columns(t(spark, d, n).select(*[c for c, _ in cols])).select(
            F.lit(n).alias("table_name"), "name", "nunique", F.round("null_pct", 6).alias("null_pct"), "kind"
        )
        for n, cols in _PROFILED.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "profile_nullable_columns",
    """WITH s AS (SELECT nullif(l_linenumber % 7, 0) AS gaps, CASE WHEN l_quantity > 25 THEN l_returnflag END AS flag,
                  NULL::DOUBLE AS nothing, 1 AS one FROM lineitem)
       SELECT 'gaps' AS name, count(DISTINCT gaps) AS nunique, round(100.0 * (count(*) - count(gaps)) / count(*), 6) AS null_pct, 'numeric' AS kind FROM s
       UNION ALL SELECT 'flag', count(DISTINCT flag), round(100.0 * (count(*) - count(flag)) / count(*), 6), 'categorical' FROM s
       UNION ALL SELECT 'nothing', count(DISTINCT nothing), round(100.0 * (count(*) - count(nothing)) / count(*), 6), 'other' FROM s
       UNION ALL SELECT 'one', count(DISTINCT one), round(100.0 * (count(*) - count(one)) / count(*), 6), 'other' FROM s""",
)
def profile_nullable_columns(spark, d):
    rows = t(spark, d, "lineitem").select(
        F.nullif(F.col("l_linenumber") % 7, F.lit(0)).alias("gaps"),
        F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).alias("flag"),
        F.lit(None).cast("double").alias("nothing"), F.lit(1).alias("one"),
    )
    return pr.profile_columns(rows).select("name", "nunique", F.round("null_pct", 6).alias("null_pct"), "kind")


@query(
    "numeric_facts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(avg({c}), 4) AS mean FROM lineitem"
        for c, k in _PROFILED["lineitem"] if k == "num"
    ),
)
def numeric_facts(spark, d):
    return pr.numeric_facts(pr.profile_columns(t(spark, d, "lineitem")))


@query(
    "datetime_facts",
    """SELECT 'o_orderdate' AS name, strftime(min(o_orderdate), '%Y-%m-%d') AS min, strftime(max(o_orderdate), '%Y-%m-%d') AS max FROM orders
       UNION ALL SELECT 'year_start', year(min(o_orderdate))::VARCHAR, year(max(o_orderdate))::VARCHAR FROM orders""",
)
def datetime_facts(spark, d):
    o = t(spark, d, "orders")
    rows = o.select("o_orderdate", F.date_trunc("year", F.col("o_orderdate").cast("timestamp")).alias("year_start"), "o_totalprice")
    return pr.datetime_facts(pr.profile_columns(rows)).select("name", "min", "max")


@query(
    "categorical_facts",
    """WITH v AS (SELECT 'p_brand' AS name, trim(p_brand) AS value FROM part UNION ALL SELECT 'p_type', trim(p_type) FROM part
                  UNION ALL SELECT 'p_name', trim(p_name) FROM part),
            c AS (SELECT name, value, count(*) AS n FROM v WHERE value <> '' GROUP BY ALL),
            k AS (SELECT name, count(*) AS distinct_values FROM c GROUP BY ALL)
       SELECT k.name, distinct_values,
              CASE WHEN distinct_values <= 300 THEN (SELECT string_agg(value, '|' ORDER BY value) FROM c WHERE c.name = k.name) END AS value_list,
              CASE WHEN distinct_values > 300 THEN (SELECT string_agg(value, '|' ORDER BY n DESC, value) FROM (SELECT * FROM c WHERE c.name = k.name ORDER BY n DESC, value LIMIT 6)) END AS examples
       FROM k""",
)
def categorical_facts(spark, d):
    facts = pr.categorical_facts(t(spark, d, "part"), ["p_brand", "p_type", "p_name"])
    return facts.select(
        "name", F.col("distinct").alias("distinct_values"), F.array_join("values", "|").alias("value_list"),
        F.array_join("examples", "|").alias("examples"),
    )


@query(
    "categorical_examples",
    """WITH c AS (SELECT c_name AS value, count(*) AS n FROM customer GROUP BY ALL)
       SELECT 'c_name' AS name, (SELECT count(*) FROM c) AS distinct_values,
              string_agg(value, '|' ORDER BY n DESC, value) AS examples
       FROM (SELECT * FROM c ORDER BY n DESC, value LIMIT 6)""",
)
def categorical_examples(spark, d):
    facts = pr.categorical_facts(t(spark, d, "customer"), ["c_name"], list_max=100)
    return facts.select("name", F.col("distinct").alias("distinct_values"), F.array_join("examples", "|").alias("examples"))


@query(
    "time_coverage",
    """SELECT 'l_shipdate' AS "column", strftime(min(l_shipdate), '%Y-%m-%d') AS "start", strftime(max(l_shipdate), '%Y-%m-%d') AS "end" FROM lineitem""",
)
def time_coverage(spark, d):
    return pr.time_coverage(pr.profile_columns(t(spark, d, "lineitem")))


@query(
    "validate_tables",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS table_name, count(*) >= 20 AS ok,
            CASE WHEN count(*) < 20 THEN 'Dataset has only ' || count(*) || ' row(s) — need at least 20 for analysis' ELSE 'ok' END AS reason,
            count(*) AS row_count FROM {n}""" for n in TABLES
    ),
)
def validate_tables(spark, d):
    parts = [
        pr.validate_table(df).select(F.lit(n).alias("table_name"), "ok", "reason", "row_count")
        for n, df in _tables(spark, d).items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "constant_columns",
    """SELECT event_type, CASE WHEN min(trim(event_type)) = max(trim(event_type)) THEN min(trim(event_type)) END AS type_constant,
              CASE WHEN min(nullif(trim(props), '')) = max(nullif(trim(props), '')) THEN min(nullif(trim(props), '')) END AS props_constant
       FROM events GROUP BY event_type""",
)
def constant_columns(spark, d):
    found = pr.constant_values(t(spark, d, "events"), ["event_type", "props"], by=["event_type"])

    def of(name):
        return F.max(F.when(F.col("name") == name, F.col("constant")))

    return found.groupBy("event_type").agg(of("event_type").alias("type_constant"), of("props").alias("props_constant"))


@query(
    "measure_labels",
    """SELECT 'value' AS "column", 'Order value' AS label, 'indicator_column' AS source, 'USD' AS unit,
              'Order value (USD)' AS axis_label,
              'The field `value` holds values for: Order value (from indicator metadata in the dataset)' AS disclosure
       FROM orders HAVING count(*) > 0""",
)
def measure_labels(spark, d):
    rows = t(spark, d, "orders").select(
        F.lit("Order value").alias("indicator"), F.lit(" USD ").alias("unit"),
        F.col("o_totalprice").alias("value"), "o_orderdate",
    )
    return pr.measure_labels(rows, ["value"], "Orders")


@query(
    "column_roles",
    """SELECT 'geo' AS role, 'country' AS name FROM orders HAVING count(*) > 0
       UNION ALL SELECT 'measure', 'value' UNION ALL SELECT 'time', 'date'""",
)
def column_roles(spark, d):
    panel = (
        t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderdate").alias("obs_date"), F.col("o_orderdate").alias("date"),
            F.col("n_name").alias("country"), F.col("c_mktsegment").alias("region"),
            F.col("c_acctbal").alias("balance"), F.col("o_totalprice").alias("value"),
        )
    )
    return pr.column_roles(pr.profile_columns(panel))


# --- relevance, headers, labels ------------------------------------------------------


@query("field_categories")
def field_categories(spark, d):
    out = None
    for n, df in _tables(spark, d).items():
        rows = pr.profile_columns(df).select(F.lit(n).alias("table"), "position", "name", "kind", "nunique")
        out = rows if out is None else out.unionByName(rows)
    return relevance.rank_fields(out, ["table"])


@query(
    "derived_calendar",
    """SELECT year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month, count(*) AS n,
              round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY ALL""",
)
def derived_calendar(spark, d):
    """The year and month dimensions recommended for orders, computed and grouped."""
    o = t(spark, d, "orders")
    advice = relevance.derived_dimensions(pr.profile_columns(o)).where("dimension = 'year'").first()
    rows = relevance.with_calendar_columns(o, advice["source_columns"][0])
    return rows.groupBy("o_orderdate_year", "o_orderdate_month").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price")
    )


@query("derived_dimensions")
def derived_dimensions(spark, d):
    o = t(spark, d, "orders").select(
        "*", (F.col("o_custkey") % 90).cast("double").alias("latitude"), (F.col("o_orderkey") % 180).cast("double").alias("lon")
    )
    return relevance.derived_dimensions(pr.profile_columns(o))


def _column_words(spark, d):
    """One column name per distinct part name, customer name and event type: headers made from data."""
    parts = t(spark, d, "part").select(F.col("p_brand").alias("table"), F.col("p_name").alias("raw"), F.col("p_partkey").alias("k"))
    name = (
        F.when(F.col("k") % 5 == 0, F.concat(F.lit("column"), F.col("k").cast("string")))
        .when(F.col("k") % 5 == 1, F.lit("x"))
        .when(F.col("k") % 5 == 2, F.col("k").cast("string"))
        .otherwise(F.col("raw"))
    )
    return parts.select("table", name.alias("name"))


@query(
    "header_quality",
    """WITH h AS (SELECT p_brand AS t, CASE p_partkey % 5 WHEN 0 THEN 'column' || p_partkey WHEN 1 THEN 'x' WHEN 2 THEN p_partkey::VARCHAR ELSE p_name END AS name FROM part),
            g AS (SELECT t, count(*) AS total, count(*) FILTER (regexp_matches(name, '^column[0-9]+$') OR regexp_matches(name, '^[0-9]+$')) AS generic FROM h GROUP BY t)
       SELECT t AS "table", total, total - generic AS meaningful, generic, (total - generic >= 2 AND generic / total < 0.5) AS ok,
         CASE WHEN total - generic < 2 THEN 'only ' || (total - generic) || ' meaningful column name(s) — headers look generic (e.g. column1, column08); need at least 2 descriptive fields'
              WHEN generic / total >= 0.5 THEN generic || ' of ' || total || ' columns have generic names — dataset likely lacks a proper header row' ELSE 'ok' END AS reason
       FROM g""",
)
def header_quality(spark, d):
    return relevance.header_quality(_column_words(spark, d), ["table"])


@query("scalar_columns")
def scalar_columns(spark, d):
    """Column lists per brand built from part rows: names, types and positions from the data."""
    dtype = F.when(F.col("p_size") % 4 == 0, "number").when(F.col("p_size") % 4 == 1, "text").when(
        F.col("p_size") % 4 == 2, "point"
    ).otherwise("calendar_date")
    cols = t(spark, d, "part").select(
        F.col("p_brand").alias("dataset"), F.col("p_partkey").cast("int").alias("position"),
        F.concat_ws("_", F.regexp_replace("p_name", " ", "_"), F.col("p_partkey").cast("string")).alias("name"),
        dtype.alias("dtype"),
    )
    return relevance.scalar_columns(cols, ["dataset"])


@query("redundant_geo_columns")
def redundant_geo_columns(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    table = n.select(
        F.col("n_name").alias("country"), F.upper(F.left("n_name", F.lit(3))).alias("countryiso3code"),
        F.col("r_name").alias("region"), F.col("r_name").alias("state"), F.left("r_name", F.lit(2)).alias("state_code"),
    )
    return relevance.redundant_geo(pr.profile_columns(table).select("position", "name", "kind"))


@query(
    "measure_slugs",
    r"""WITH l AS (SELECT DISTINCT p_name || CASE WHEN p_size % 2 = 0 THEN ' (%)' ELSE '' END AS a, p_size::VARCHAR || ' ' || p_name AS b FROM part),
            s AS (SELECT a, b, trim(left(trim(regexp_replace(lower(a), '[^a-z0-9]+', '_', 'g'), '_'), 48), '_') AS slug_a,
                  trim(left(trim(regexp_replace(lower(b), '[^a-z0-9]+', '_', 'g'), '_'), 48), '_') AS sb FROM l)
       SELECT a AS label, b AS numbered, slug_a AS slug, CASE WHEN regexp_matches(sb, '^[0-9]') THEN 'measure_' || sb ELSE sb END AS numbered_slug FROM s""",
)
def measure_slugs(spark, d):
    labels = t(spark, d, "part").select(
        F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " (%)").otherwise("")).alias("label"),
        F.concat_ws(" ", F.col("p_size").cast("string"), "p_name").alias("numbered"),
    ).distinct()
    return labels.select("label", "numbered", text.slug(F.col("label")).alias("slug"), text.slug(F.col("numbered")).alias("numbered_slug"))


_HUMAN_SQL = """CASE WHEN contains(n, '_') THEN upper(left(h, 1)) || lower(substr(h, 2)) ELSE n END"""


@query(
    "column_glossary",
    f"""WITH raw AS (SELECT replace(p_name, ' ', '_') AS n, min(p_partkey) AS pos FROM part GROUP BY ALL
                     UNION ALL SELECT 'Country', -2 UNION ALL SELECT 'country', -1),
             k AS (SELECT n, pos, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') AS key, replace(n, '_', ' ') AS h FROM raw),
             f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS r FROM k)
        SELECT n AS name, CASE WHEN key = 'country' THEN 'Country' ELSE {_HUMAN_SQL} END AS label,
               CASE WHEN key = 'country' THEN 'Country name or label.' END AS description FROM f WHERE r = 1""",
)
def column_glossary(spark, d):
    from openstat.operators.catalog import glossary

    names = t(spark, d, "part").groupBy(F.regexp_replace("p_name", " ", "_").alias("name")).agg(
        F.min("p_partkey").cast("int").alias("position")
    )
    extra = names.agg(F.lit("Country").alias("name"), F.lit(-2).alias("position")).unionByName(
        names.agg(F.lit("country").alias("name"), F.lit(-1).alias("position"))
    )
    return glossary(names.unionByName(extra)).select("name", "label", "description")


# --- ad-hoc questions and listings ----------------------------------------------------


def _analysis_views(spark, d):
    return {"analysis_0": t(spark, d, "orders"), "analysis_1": t(spark, d, "lineitem"), "raw_0": t(spark, d, "part")}


@query(
    "ask_select",
    """SELECT o_orderstatus AS status, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus""",
)
def ask_select(spark, d):
    return filters.ask(
        _analysis_views(spark, d),
        "SELECT o_orderstatus AS status, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue "
        "FROM analysis_0 JOIN analysis_1 ON o_orderkey = l_orderkey GROUP BY o_orderstatus",
    )


@query(
    "ask_select_capped",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 25",
)
def ask_select_capped(spark, d):
    return filters.ask(
        _analysis_views(spark, d),
        "SELECT o_custkey, count(*) AS n FROM analysis_0 GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 5000",
    )


@query(
    "describe_tables",
    """SELECT 'analysis_0' AS "table", column_name AS name, column_index AS position, (SELECT count(*) FROM orders) AS n_rows
       FROM (SELECT unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']) AS column_name, unnest([0,1,2,3,4,5]) AS column_index)
       UNION ALL SELECT 'analysis_1', column_name, column_index, (SELECT count(*) FROM lineitem)
       FROM (SELECT unnest(['l_orderkey','l_partkey','l_suppkey','l_linenumber','l_quantity','l_extendedprice','l_discount','l_tax','l_returnflag','l_linestatus','l_shipdate']) AS column_name, unnest([0,1,2,3,4,5,6,7,8,9,10]) AS column_index)""",
)
def describe_tables(spark, d):
    return filters.describe_tables(_analysis_views(spark, d)).select("table", "name", "position", "n_rows")


# --- samples --------------------------------------------------------------------------


@query(
    "sample_size",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS table_name, CASE WHEN n <= 1000 THEN n ELSE least(1000, greatest(200, round_even(0.05 * n, 0)::BIGINT)) END AS analysis_n,
            CASE WHEN n <= 100000 THEN 'full_ok' WHEN n <= 1000000 THEN 'recommend_filter' ELSE 'require_filter' END AS tier
            FROM (SELECT count(*) AS n FROM {n})""" for n in TABLES
    ),
)
def sample_size(spark, d):
    out = None
    for n, df in _tables(spark, d).items():
        rows = df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(n).alias("table_name"),
            sampling.analysis_rows(F.col("n"), cap=1000, floor=200).alias("analysis_n"),
            sampling.sampling_tier(F.col("n")).alias("tier"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "seeded_sample",
    """SELECT CASE WHEN n <= 20000 THEN n ELSE least(20000, greatest(1000, round_even(0.05 * n, 0)::BIGINT)) END AS sampled, TRUE AS subset
       FROM (SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 2)""",
)
def seeded_sample(spark, d):
    """Size of the sample, and whether every sampled row is a row of the filtered table."""
    lines = t(spark, d, "lineitem")
    chosen = sampling.analysis_sample(lines, "l_quantity >= 2", cap=20_000, floor=1_000)
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    source = lines.where("l_quantity >= 2").select(*keys).distinct()
    matched = chosen.join(source, keys, "left_semi").agg(F.count(F.lit(1)).alias("m"))
    return chosen.agg(F.count(F.lit(1)).alias("sampled")).withColumn(
        "subset", F.col("sampled") == matched.scalar()
    )


@query("model_sample", "SELECT least(count(*), 5000) AS n, 4 AS n_columns FROM lineitem")
def model_sample(spark, d):
    rows = sampling.model_sample(
        t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], n=5000
    )
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("n_columns", F.lit(len(rows.columns)))


# --- descriptive ------------------------------------------------------------------------


@query(
    "row_counts",
    """SELECT 'orders' AS table_name, count(*) AS n_rows, 6 AS n_columns FROM orders
       UNION ALL SELECT 'lineitem', count(*), 11 FROM lineitem UNION ALL SELECT 'part', count(*), 6 FROM part""",
)
def row_counts(spark, d):
    out = None
    for n in ("orders", "lineitem", "part"):
        rows = descriptive.row_count(t(spark, d, n)).select(F.lit(n).alias("table_name"), "n_rows", "n_columns")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "summary_stats",
    """SELECT 'l_quantity' AS "column", count(l_quantity) AS n, min(l_quantity)::DOUBLE AS min, max(l_quantity)::DOUBLE AS max,
              round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median FROM lineitem""",
)
def summary_stats(spark, d):
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    stats = descriptive.summary_stats(t(spark, d, "lineitem"), columns)
    return stats.select("column", "n", "min", "max", F.round("mean", 6).alias("mean"), "median")


@query(
    "top_values",
    "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 5",
)
def top_values(spark, d):
    return descriptive.top_values(t(spark, d, "orders"), "o_orderpriority")


def _nation_customers(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))


@query(
    "geo_extremes",
    """WITH m AS (SELECT n_name AS geo, avg(c_acctbal) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
       SELECT count(*) AS areas, arg_max(geo, mean) AS highest, round(max(mean), 4) AS highest_mean, arg_min(geo, mean) AS lowest, round(min(mean), 4) AS lowest_mean FROM m""",
)
def geo_extremes(spark, d):
    rows = descriptive.geo_extremes(_nation_customers(spark, d), "n_name", "c_acctbal")
    return rows.select("areas", "highest", F.round("highest_mean", 4).alias("highest_mean"), "lowest", F.round("lowest_mean", 4).alias("lowest_mean"))


@query(
    "time_change",
    """WITH y AS (SELECT year(o_orderdate) AS t, avg(o_totalprice) AS mean, count(*) AS c FROM orders GROUP BY 1)
       SELECT sum(c)::BIGINT AS n_rows, count(*) AS times, min(t)::BIGINT AS first_time, max(t)::BIGINT AS last_time,
              round(arg_min(mean, t), 4) AS first_mean, round(arg_max(mean, t), 4) AS last_mean,
              round((arg_max(mean, t) - arg_min(mean, t)) / abs(arg_min(mean, t)) * 100, 6) AS pct_change FROM y""",
)
def time_change(spark, d):
    o = t(spark, d, "orders").select(F.year("o_orderdate").cast("bigint").alias("year"), "o_totalprice")
    rows = descriptive.time_change(o, "year", "o_totalprice")
    return rows.select(
        "n_rows", "times", "first_time", "last_time", F.round("first_mean", 4).alias("first_mean"),
        F.round("last_mean", 4).alias("last_mean"), F.round("pct_change", 6).alias("pct_change"),
    )


@query("descriptive_findings")
def descriptive_findings(spark, d):
    from openstat.plans.analysis import profile_table

    o = t(spark, d, "orders")
    return descriptive.descriptive_findings(o, profile_table(o, "Orders", "orders"))


@query(
    "coverage_notes",
    """WITH n AS (SELECT 0 AS pos, 'Planned 4 statistical test(s) on the loaded sample (0 significant at p < 0.05, 0 total ranked result(s)).' AS note
                  UNION ALL SELECT 1, 'region — small sample (' || count(*) || ' rows); many tests need more data.' FROM region HAVING count(*) < 20
                  UNION ALL SELECT 2, 'region — only 1 numeric field(s); correlation/regression tests were not applicable.' FROM region
                  GROUP BY ALL HAVING count(*) > 0)
       SELECT (row_number() OVER (ORDER BY pos) - 1)::INT AS position, note FROM n""",
)
def coverage_notes(spark, d):
    from openstat.plans.analysis import profile_table

    profiles = [profile_table(t(spark, d, n), n, n) for n in ("region", "orders")]
    return descriptive.coverage_notes(spark, profiles, 4, 0, 0)


@query("context_bundle")
def context_bundle(spark, d):
    from openstat.operators.catalog import table_context

    return table_context({n: t(spark, d, n) for n in ("orders", "part")}, {"orders": "Orders", "part": "Parts"})


# --- joins ------------------------------------------------------------------------------


def _lines(spark, d):
    return t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")


@query(
    "join_shared_key",
    """SELECT o_orderstatus, l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""",
)
def join_shared_key(spark, d):
    rows = joins.join_tables(t(spark, d, "orders"), _lines(spark, d), [("o_orderkey", "o_orderkey")])
    return rows.groupBy("o_orderstatus", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue")
    )


@query(
    "join_different_keys",
    "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance, max(c_nationkey) AS c_key, max(n_nationkey) AS n_key FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
)
def join_different_keys(spark, d):
    rows = joins.join_tables(t(spark, d, "customer"), t(spark, d, "nation"), [("c_nationkey", "n_nationkey")])
    return rows.groupBy("n_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"),
        F.max("c_nationkey").alias("c_key"), F.max("n_nationkey").alias("n_key"),
    )


@query(
    "join_renamed_measures",
    """SELECT o_orderstatus AS status, round(sum(o_totalprice), 2) AS order_value, round(sum(l_extendedprice), 2) AS line_value, max(l_linenumber) AS max_line
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""",
)
def join_renamed_measures(spark, d):
    """Both sides carry `value` and `note`; measures get their own names, the other clash gets _1."""
    left = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("note"))
    right = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("value"), F.col("l_linenumber").alias("note"))
    rows = joins.join_tables(left, right, joins.join_pairs(["id"]), {"value": "order_value"}, {"value": "line_value"})
    return rows.groupBy(F.col("note").alias("status")).agg(
        F.round(F.sum("order_value"), 2).alias("order_value"), F.round(F.sum("line_value"), 2).alias("line_value"),
        F.max("note_1").alias("max_line"),
    )


@query("join_row_count", "SELECT count(*) AS matched_rows FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_row_count(spark, d):
    return joins.join_row_count(t(spark, d, "orders"), _lines(spark, d), [("o_orderkey", "o_orderkey")])


@query(
    "key_duplication",
    "SELECT max(c) AS max_rows_per_key FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, nullif(l_linenumber % 7, 0))",
)
def key_duplication(spark, d):
    lines = t(spark, d, "lineitem").withColumn("gap", F.nullif(F.col("l_linenumber") % 7, F.lit(0)))
    return joins.max_duplication(lines, ["l_orderkey", "gap"])


_OVERLAP_SQL = """
  WITH l AS (SELECT DISTINCT nullif(o_custkey % 11, 0) * 100000 + o_custkey AS k FROM orders),
       r AS (SELECT DISTINCT nullif(c_custkey % 11, 0) * 100000 + c_custkey AS k FROM customer)
  SELECT round((SELECT count(*) FROM l WHERE k IN (SELECT k FROM r WHERE k IS NOT NULL)) / (SELECT count(*) FROM l), 9) AS overlap_left,
         round((SELECT count(*) FROM r WHERE k IN (SELECT k FROM l WHERE k IS NOT NULL)) / (SELECT count(*) FROM r), 9) AS overlap_right"""


@query("key_overlap", _OVERLAP_SQL)
def key_overlap(spark, d):
    def key(c):
        return F.nullif(F.col(c) % 11, F.lit(0)) * 100_000 + F.col(c)

    left = t(spark, d, "orders").select(key("o_custkey").alias("k"))
    right = t(spark, d, "customer").select(key("c_custkey").alias("k"))
    rows = joins.key_overlap(left, right, [("k", "k")])
    return rows.select(F.round("overlap_left", 9).alias("overlap_left"), F.round("overlap_right", 9).alias("overlap_right"))


def _assess_sql(name, left, lk, right, rk):
    return f"""
      SELECT '{name}' AS pair, dl <= 1 OR dr <= 1 AS keys_ok,
             CASE WHEN dl > 1 AND dr > 1 THEN 0 ELSE m END AS matched_rows,
             CASE WHEN dl > 1 AND dr > 1 THEN 0.0 ELSE round(bl / nl, 9) END AS overlap_left,
             CASE WHEN dl > 1 AND dr > 1 THEN 0.0 ELSE round(bl / nr, 9) END AS overlap_right
      FROM (SELECT (SELECT max(c) FROM (SELECT count(*) AS c FROM {left} GROUP BY {lk})) AS dl,
                   (SELECT max(c) FROM (SELECT count(*) AS c FROM {right} GROUP BY {rk})) AS dr,
                   (SELECT count(*) FROM {left} JOIN {right} ON {lk} = {rk}) AS m,
                   (SELECT count(DISTINCT {lk}) FROM {left}) AS nl, (SELECT count(DISTINCT {rk}) FROM {right}) AS nr,
                   (SELECT count(DISTINCT {lk}) FROM {left} WHERE {lk} IN (SELECT {rk} FROM {right})) AS bl)"""


_ASSESSED = [
    ("orders-customer", "orders", "o_custkey", "customer", "c_custkey"),
    ("orders-lineitem", "orders", "o_orderkey", "lineitem", "l_orderkey"),
    ("lineitem-part", "lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem-orders-by-cust", "lineitem", "l_suppkey", "orders", "o_custkey"),
    ("customer-supplier", "customer", "c_nationkey", "supplier", "s_nationkey"),
]


@query("assess_joins", " UNION ALL ".join(_assess_sql(*a) for a in _ASSESSED))
def assess_joins(spark, d):
    out = None
    for name, left, lk, right, rk in _ASSESSED:
        rows = joins.assess_join(t(spark, d, left), t(spark, d, right), [(lk, rk)]).select(
            F.lit(name).alias("pair"),
            (F.col("warning").isNull() | ~F.col("warning").startswith("Join key repeats")).alias("keys_ok"),
            "matched_rows", F.round("overlap_left", 9).alias("overlap_left"), F.round("overlap_right", 9).alias("overlap_right"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _keyed(spark, d):
    left = t(spark, d, "orders").select(
        F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("year"),
        F.col("o_totalprice").alias("value"),
    )
    right = t(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), (F.lit(1990) + F.col("c_nationkey")).alias("fiscal_year"), F.col("c_acctbal").alias("balance")
    )
    return left, right


@query(
    "join_candidates",
    """WITH l AS (SELECT o_orderkey AS record_id, o_custkey AS id, year(o_orderdate) AS year FROM orders),
            r AS (SELECT c_custkey AS id, 1990 + c_nationkey AS fiscal_year FROM customer)
       SELECT 1 AS position, 'id' AS label, (SELECT count(*) FROM (SELECT DISTINCT id FROM l WHERE id IS NOT NULL) SEMI JOIN r USING (id)) AS shared_keys
       UNION ALL SELECT 2, 'record_id ↔ id', (SELECT count(DISTINCT record_id) FROM l WHERE record_id IN (SELECT id FROM r))
       UNION ALL SELECT 3, 'year ↔ fiscal_year', (SELECT count(DISTINCT year) FROM l WHERE year IN (SELECT fiscal_year FROM r))""",
)
def join_candidates(spark, d):
    """Candidates from the column names, each with the key values that both tables hold."""
    left, right = _keyed(spark, d)
    found = []
    for i, pairs in enumerate(joins.candidate_pairs(left, right), 1):
        keys = [f"k{n}" for n in range(len(pairs))]
        sides = [df.select(*[F.col(p[s]).alias(k) for k, p in zip(keys, pairs)]).dropna().distinct() for s, df in enumerate((left, right))]
        found.append(
            sides[0].join(sides[1], keys).agg(F.count(F.lit(1)).alias("shared_keys"))
            .select(F.lit(i).alias("position"), F.lit(joins.pair_label(pairs)).alias("label"), "shared_keys")
        )
    return reduce(DataFrame.unionByName, found)


_SUGGEST_SQL = f"""
  WITH l AS (SELECT o_orderkey AS record_id, o_custkey AS id, year(o_orderdate) AS yr FROM orders),
       r AS (SELECT c_custkey AS id, 1990 + c_nationkey AS fy FROM customer),
       a AS ({_assess_sql('id', 'l', 'l.id', 'r', 'r.id').replace("l.id = r.id", "l.id = r.id")}
             UNION ALL {_assess_sql('record_id ↔ id', 'l', 'l.record_id', 'r', 'r.id')}
             UNION ALL {_assess_sql('year ↔ fiscal_year', 'l', 'l.yr', 'r', 'r.fy')}),
       s AS (SELECT *, keys_ok AND matched_rows >= 8 AS ok FROM a),
       c AS (SELECT pair AS label, ok, matched_rows, round(overlap_left, 4) AS overlap_left_pct, round(overlap_right, 4) AS overlap_right_pct,
               round(CASE WHEN ok THEN least(1.0, least(overlap_left, overlap_right)) ELSE 0.5 * least(overlap_left, overlap_right) END, 4) AS score FROM s),
       o AS (SELECT *, row_number() OVER (ORDER BY ok DESC, score DESC, matched_rows DESC) AS rank FROM c)
  SELECT *, coalesce(rank = (SELECT min(rank) FROM o WHERE ok AND score >= 0.75), FALSE) AS auto_recommended FROM o"""


@query("suggest_joins", _SUGGEST_SQL)
def suggest_joins(spark, d):
    left, right = _keyed(spark, d)
    return joins.suggest_joins(left, right).select(
        "label", "ok", "matched_rows", "overlap_left_pct", "overlap_right_pct", "score",
        F.col("rank").cast("bigint").alias("rank"), "auto_recommended",
    )


@query("select_join", f"SELECT label FROM ({_SUGGEST_SQL}) WHERE ok ORDER BY auto_recommended DESC, rank LIMIT 1")
def select_join(spark, d):
    left, right = _keyed(spark, d)
    return joins.select_join(joins.suggest_joins(left, right)).select("label")


@query(
    "explicit_join_pairs",
    "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM orders JOIN customer ON o_custkey = c_custkey",
)
def explicit_join_pairs(spark, d):
    """Explicit pairs win over the shared key names that are also given."""
    left, right = _keyed(spark, d)
    pairs = joins.join_pairs(["year"], [{"left": " id ", "right": "id"}, {"left": "", "right": "id"}])
    return joins.join_tables(left, right, pairs).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("balance")
    )


# --- harmonized panels --------------------------------------------------------------------


def _order_panel(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("n_name").alias("country"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("value"))


def _line_panel(spark, d):
    rows = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("n_name").alias("country"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_extendedprice").alias("value")
    )


_ENTITY_SQL = (
    "CASE WHEN n_name <> '' AND NOT ("
    + " OR ".join(f"contains(lower(n_name), '{m}')" for m in rules.AGGREGATE_MARKERS)
    + ") THEN lower(trim(n_name)) END"
)
_ORDER_PANEL_SQL = f"""SELECT {_ENTITY_SQL} AS entity_id, year(o_orderdate) AS year, avg(o_totalprice) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 HAVING entity_id IS NOT NULL"""
_LINE_PANEL_SQL = f"""SELECT {_ENTITY_SQL} AS entity_id, year(l_shipdate) AS year, avg(l_extendedprice) AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2 HAVING entity_id IS NOT NULL"""


@query("panel_means", f"SELECT entity_id, year::BIGINT AS year, round(value, 6) AS value FROM ({_ORDER_PANEL_SQL})")
def panel_means(spark, d):
    rows = joins.panel_means(_order_panel(spark, d), "country", "date", "value")
    return rows.select("entity_id", F.col("year").cast("bigint").alias("year"), F.round("value", 6).alias("value"))


def merged_panel(spark, d):
    return joins.merge_panels(
        joins.panel_means(_order_panel(spark, d), "country", "date", "value"),
        joins.panel_means(_line_panel(spark, d), "country", "date", "value"),
    )


MERGED_SQL = f"""SELECT a.entity_id, a.year, a.value AS value_a, b.value AS value_b
  FROM ({_ORDER_PANEL_SQL}) a JOIN ({_LINE_PANEL_SQL}) b ON a.entity_id = b.entity_id AND a.year = b.year"""


@query("merge_panels", f"SELECT entity_id, year::BIGINT AS year, round(value_a, 6) AS value_a, round(value_b, 6) AS value_b FROM ({MERGED_SQL})")
def merge_panels(spark, d):
    return merged_panel(spark, d).select(
        "entity_id", F.col("year").cast("bigint").alias("year"), F.round("value_a", 6).alias("value_a"), F.round("value_b", 6).alias("value_b")
    )


@query(
    "panel_coverage",
    f"SELECT count(*) AS matched_pairs, count(DISTINCT entity_id) AS entities, min(year)::BIGINT AS year_start, max(year)::BIGINT AS year_end, 'country_year' AS strategy FROM ({MERGED_SQL})",
)
def panel_coverage(spark, d):
    panels = [joins.detect_panel(p.columns) for p in (_order_panel(spark, d), _line_panel(spark, d))]
    strategy = joins.panel_strategy(panels[0]["entity_kind"], panels[1]["entity_kind"])
    rows = joins.panel_coverage(merged_panel(spark, d), strategy)
    return rows.select(
        "matched_pairs", "entities", F.col("year_start").cast("bigint").alias("year_start"),
        F.col("year_end").cast("bigint").alias("year_end"), "strategy",
    )


@query(
    "entity_normalize",
    f"SELECT n_name AS name, {_ENTITY_SQL} AS entity_id, CASE WHEN regexp_matches(upper(left(n_name, 3)), '^[A-Z]{{3}}$') THEN upper(left(n_name, 3)) END AS code FROM nation",
)
def entity_normalize(spark, d):
    n = t(spark, d, "nation")
    return n.select(
        F.col("n_name").alias("name"), joins.entity_id(F.col("n_name"), "name").alias("entity_id"),
        joins.entity_id(F.left("n_name", F.lit(3)), "iso3").alias("code"),
    )


@query(
    "year_extract",
    """SELECT year(o_orderdate)::BIGINT AS y, count(*) AS n FROM orders GROUP BY ALL""",
)
def year_extract(spark, d):
    """Years from four layouts, one per order, must all land on the order's own year."""
    from openstat.functions.times import year_of

    o = t(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    layout = (
        F.when(k == 0, F.date_format("o_orderdate", "yyyy"))
        .when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(k == 2, F.date_format("o_orderdate", "MM/dd/yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return o.select(year_of(layout, "string").cast("bigint").alias("y")).groupBy("y").agg(F.count(F.lit(1)).alias("n"))
