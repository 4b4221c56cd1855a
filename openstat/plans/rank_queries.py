"""Registered queries: curation rules and card searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from openstat.functions import text
from openstat.operators import curation, places
from openstat.plans.registry import query
from openstat.session import read_table as t


@query(
    "diversity_caps",
    """WITH c AS (SELECT doc_id AS id, source || ':' || (doc_id % 40) AS family, source AS topic, doc_id AS seq, doc_id % 97 = 0 AS curated FROM documents),
            f AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY curated DESC, seq) AS fr FROM c), k AS (SELECT * FROM f WHERE curated OR fr <= 2),
            g AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY curated DESC, seq) AS tr FROM k)
       SELECT id, family, topic FROM g WHERE curated OR tr <= 25""",
)
def diversity_caps(spark, d):
    """Families inside one source: the greedy walk equals two ranked filters."""
    rows = t(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.col("source"), F.lit(":"), (F.col("doc_id") % 40).cast("string")).alias("family"),
        F.col("source").alias("topic"), F.col("doc_id").alias("seq"), (F.col("doc_id") % 97 == 0).alias("curated"),
    )
    return curation.diversity_caps(rows, 2, 25).select("id", "family", "topic")


@query("diversity_caps_spanning")
def diversity_caps_spanning(spark, d):
    """Families that span sources; checked against a plain walk in the tests."""
    rows = t(spark, d, "documents").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 300).cast("string").alias("family"), F.col("source").alias("topic"),
        F.col("doc_id").alias("seq"), (F.col("doc_id") % 97 == 0).alias("curated"),
    )
    return curation.diversity_caps(rows, 2, 25).select("id", "family", "topic")


@query(
    "title_families",
    r"""WITH x AS (SELECT DISTINCT p_name || CASE WHEN p_size % 2 = 0 THEN ', ADB to Laos (USD million)' ELSE '  extra ;' END AS title, CASE WHEN p_size % 5 = 0 THEN 'SL.UEM.' || p_size ELSE 'x' || p_size END AS code, p_name, p_size % 2 = 0 AS donor FROM part)
       SELECT title, code, CASE WHEN regexp_matches(code, '^[A-Z]{2}\.[A-Z0-9._]+$') THEN 'wdi:' || code ELSE 'title:' || p_name || CASE WHEN donor THEN '' ELSE ' extra' END END AS family FROM x""",
)
def title_families(spark, d):
    p = t(spark, d, "part")
    title = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, ", ADB to Laos (USD million)").otherwise("  extra ;"))
    code = F.concat(F.when(F.col("p_size") % 5 == 0, "SL.UEM.").otherwise("x"), F.col("p_size").cast("string"))
    rows = p.select(title.alias("title"), code.alias("code")).distinct()
    return rows.select("title", "code", text.indicator_family(F.col("code"), F.col("title")).alias("family"))


@query(
    "newest_candidates",
    """SELECT user_id AS id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS recency FROM events GROUP BY 1 ORDER BY max(ts) DESC, 1 LIMIT 127""",
)
def newest_candidates(spark, d):
    e = t(spark, d, "events")
    sources = [e.where(F.col("event_type") == k).select(F.col("user_id").alias("id"), F.col("ts").alias("recency")) for k in ("view", "click", "purchase")]
    rest = e.where(~F.col("event_type").isin("view", "click", "purchase")).select(F.col("user_id").alias("id"), F.col("ts").alias("recency"))
    return curation.newest_candidates([*sources, rest], 30, 97).withColumn("recency", F.date_format("recency", "yyyy-MM-dd HH:mm:ss"))


@query(
    "meaningful_views",
    """SELECT event_type, count(*) AS n FROM events WHERE user_id % 7 <> 0 AND user_id % 11 <> 0 AND event_type NOT IN ('click') AND event_id % 13 <> 0 AND (props->>'k')::INT >= 2 GROUP BY 1""",
)
def meaningful_views(spark, d):
    e = t(spark, d, "events").select(
        "event_type", F.when(F.col("event_type") == "click", "Map").otherwise(F.lit(None).cast("string")).alias("view_type"),
        F.when(F.col("event_id") % 13 == 0, "  ").otherwise("t").alias("title"), (F.col("user_id") % 7 == 0).alias("hide_from_catalog"),
        (F.col("user_id") % 11 == 0).alias("hide_from_data"), F.get_json_object("props", "$.k").cast("int").alias("scalar_columns"),
    )
    return curation.meaningful_views(e).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "probe_batch",
    "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate, o_orderkey LIMIT 500",
)
def probe_batch(spark, d):
    o = t(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("ingestible"),
        F.when(F.col("o_orderstatus") == "O", "pending probe").otherwise("no distribution URL").alias("ingest_block_reason"),
        F.col("o_orderdate").alias("updated_at"),
    )
    return curation.probe_batch(o).select("id")


@query(
    "sync_budget",
    """WITH x AS (SELECT doc_id AS seq, n_chars > 800 AS ok FROM documents ORDER BY doc_id LIMIT 900),
            r AS (SELECT *, coalesce(sum(ok::INT) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 60 AS probed FROM x)
       SELECT seq, probed, probed AND ok AS ingestible, CASE WHEN NOT probed THEN 'pending probe' WHEN NOT ok THEN 'not ingestible' END AS ingest_block_reason FROM r""",
)
def sync_budget(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("seq"), "n_chars")
    return curation.sync_budget(docs, 60, 900, F.col("n_chars") > 800).drop("n_chars")


# --- cards ---------------------------------------------------------------------------------


def _places(spark, d):
    """Suppliers of each part as places: the part is the cuisine, the supplier the name."""
    lines = t(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber")
    rows = lines.join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    k = F.col("s_nationkey") % 3
    borough = F.when(k == 0, "Brooklyn").when(k == 1, "Queens").otherwise("Manhattan")
    return rows.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("p_name").alias("category"), borough.alias("borough"),
        F.concat(F.lit("Street "), F.col("p_size").cast("string")).alias("street"), F.chr(F.lit(65) + F.col("l_linenumber") % 3).alias("grade"),
        F.concat_ws(", ", F.concat(F.lit("Street "), F.col("p_size").cast("string")), borough).alias("address"),
    )


_PLACES = """SELECT s_suppkey AS id, s_name AS name, p_name AS category, CASE s_nationkey % 3 WHEN 0 THEN 'Brooklyn' WHEN 1 THEN 'Queens' ELSE 'Manhattan' END AS borough,
  'Street ' || p_size AS street, chr(65 + l_linenumber % 3) AS grade FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"""


@query(
    "search_places",
    f"""WITH w AS (SELECT * FROM ({_PLACES}) WHERE contains(upper(category), 'WIDGET') AND borough = 'Brooklyn'),
            c AS (SELECT DISTINCT id, name, grade FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY grade, name) AS r FROM w) WHERE r = 1 ORDER BY grade, name, id LIMIT 8)
        SELECT id, name, grade FROM c""",
)
def search_places(spark, d):
    return places.search_places(_places(spark, d), area="Brooklyn", category="widget").select("id", "name", "grade")


@query(
    "search_places_by_text",
    f"""WITH w AS (SELECT * FROM ({_PLACES}) WHERE contains(upper(street), 'STREET 7')),
            c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY grade, name) AS r FROM w) WHERE r = 1 ORDER BY grade, name, id LIMIT 8)
        SELECT id, name, grade FROM c""",
)
def search_places_by_text(spark, d):
    return places.search_places(_places(spark, d), area="street 7").select("id", "name", "grade")


def _cards(spark, d):
    e = t(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "arts").when(F.col("event_type") == "click", "theater").otherwise(F.col("event_type"))
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("Show "), F.col("user_id").cast("string")).alias("name"),
        F.concat(F.lit("Hall "), (F.col("user_id") % 20).cast("string")).alias("venue"), F.concat(F.lit("Area "), (F.col("user_id") % 5).cast("string")).alias("area"),
        F.lit("New York").alias("city"), kind.alias("category"), F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).alias("date"),
    )


@query(
    "search_events",
    """SELECT event_id AS id, 'Show ' || user_id AS name, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE '2024-02-01' END AS date FROM events
       WHERE event_type IN ('view', 'click') AND user_id % 5 = 3 AND contains('show ' || user_id || ' hall ' || (user_id % 20) || ' area 3 new york ' || CASE event_type WHEN 'view' THEN 'arts' ELSE 'theater' END, 'hall 1') ORDER BY event_id LIMIT 8""",
)
def search_events(spark, d):
    return places.search_events(_cards(spark, d), area="area 3", category="theater", keyword="hall 1", today="2024-02-01").select("id", "name", "date")


@query("search_events_fallback", "SELECT event_id AS id FROM events ORDER BY event_id LIMIT 5")
def search_events_fallback(spark, d):
    return places.search_events(_cards(spark, d), keyword="nothing like this").select("id")


@query(
    "dedupe_cards",
    "SELECT event_type AS type, user_id % 20 AS name_key, min(event_id) AS id FROM events GROUP BY ALL",
)
def dedupe_cards(spark, d):
    cards = t(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("type"), (F.col("user_id") % 20).alias("name_key"),
        F.concat(F.when(F.col("event_id") % 2 == 0, "CARD ").otherwise("card "), (F.col("user_id") % 20).cast("string")).alias("name"),
    )
    return places.dedupe_cards(cards, ["id"]).select("type", "name_key", "id")
