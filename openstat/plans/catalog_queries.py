"""Registered queries: catalog search, themes, curated paths, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from openstat import rules
from openstat.functions import text
from openstat.operators import joins, metrics, search
from openstat.plans.registry import query
from openstat.session import read_table as t


def catalog(spark, d):
    """Documents as catalog rows; titles carry theme words so that searches have something to rank."""
    k = F.col("doc_id") % 6
    word = (
        F.when(k == 0, "Unemployment and wage").when(k == 1, "Hospital mortality").when(k == 2, "Forest and water")
        .when(k == 3, "School enrollment").when(k == 4, "Poverty").otherwise("Notes")
    )
    docs = t(spark, d, "documents")
    title = F.concat_ws(" ", word, "source")
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 4 == 0, "world_bank").when(F.col("doc_id") % 4 == 1, "fred").when(F.col("doc_id") % 4 == 2, "data_gov").otherwise("nyc_open_data").alias("portal"),
        title.alias("title"), F.col("text").alias("description"), F.col("source").alias("organization"),
        F.array(F.when(F.col("doc_id") % 9 == 0, " health ").otherwise(F.col("lang"))).alias("tags"),
        F.when(F.col("doc_id") % 2 == 0, "csv").otherwise("xml").alias("format"), F.col("n_chars").alias("row_count_hint"),
        F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("doc_id") % 5 + 1), lambda i: F.struct(i.cast("string").alias("name"))).alias("columns"),
        (F.col("doc_id") % 10 != 3).alias("ingestible"),
        F.when(F.col("doc_id") % 10 == 3, F.when(F.col("lang") == "en", "CSV has no data rows")).alias("ingest_block_reason"),
    )
    return rows.withColumn("search_text", F.lower(F.concat_ws(" ", "title", "description", "organization")))


_CATALOG = """SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'world_bank' WHEN 1 THEN 'fred' WHEN 2 THEN 'data_gov' ELSE 'nyc_open_data' END AS portal,
  CASE doc_id % 6 WHEN 0 THEN 'Unemployment and wage' WHEN 1 THEN 'Hospital mortality' WHEN 2 THEN 'Forest and water' WHEN 3 THEN 'School enrollment' WHEN 4 THEN 'Poverty' ELSE 'Notes' END || ' ' || source AS title,
  text AS description, source, CASE WHEN doc_id % 9 = 0 THEN 'health' ELSE lang END AS tag, CASE WHEN doc_id % 2 = 0 THEN 'csv' ELSE 'xml' END AS format, n_chars AS hint, doc_id % 5 + 1 AS n_columns,
  doc_id % 10 <> 3 AS ingestible, CASE WHEN doc_id % 10 = 3 AND lang = 'en' THEN 'CSV has no data rows' END AS reason FROM documents"""
_CATALOG = f"SELECT *, lower(title || ' ' || description || ' ' || source) AS search_text, id % 50 = 0 AS featured, id % 35 = 0 AS curated FROM ({_CATALOG})"

_QUALITY = """round(least(1.0, (CASE WHEN featured THEN 0.45 WHEN curated THEN 0.25 ELSE 0 END) + (CASE WHEN hint >= 10000 THEN 0.35 WHEN hint >= 1000 THEN 0.25 WHEN hint >= 100 THEN 0.12 ELSE 0 END)
  + (CASE portal WHEN 'world_bank' THEN 0.15 WHEN 'fred' THEN 0.12 WHEN 'data_gov' THEN 0.05 ELSE 0 END) + (CASE WHEN format = 'csv' THEN 0.08 ELSE 0 END) + (CASE WHEN n_columns >= 3 THEN 0.05 ELSE 0 END)), 4)"""


def _featured():
    return F.col("id") % 50 == 0


def _curated():
    return F.col("id") % 35 == 0


@query("quality_prior", f"SELECT id, {_QUALITY} AS quality FROM ({_CATALOG})")
def quality_prior(spark, d):
    return catalog(spark, d).select("id", search.quality_prior(_featured(), _curated()).alias("quality"))


def _ranked_sql(words):
    hits = " + ".join(f"(CASE WHEN contains(search_text, '{w}') THEN 1 ELSE 0 END)" for w in words)
    boost = " + ".join(f"(CASE WHEN regexp_matches(left(search_text, 200), '\\b{w}\\b') THEN 0.15 ELSE 0 END)" for w in words)
    matched = ", ".join(f"CASE WHEN contains(lower(title), '{w}') OR contains(search_text, '{w}') THEN '{w}' END" for w in words)
    return f"""SELECT *, round(({hits}) / {len(words)} * 0.65 + ({boost}) * 0.65 + quality * 0.35, 6) AS combined, hits_list FROM (
        SELECT *, {_QUALITY} AS quality, list_filter([{matched}], lambda m: m IS NOT NULL) AS hits_list FROM ({_CATALOG})) WHERE ({hits}) > 0"""


_WORDS = ["water", "school", "mortality", "enrollment", "src1", "wage"]


@query(
    "rank_catalog",
    f"""SELECT id, len(hits_list) AS hits, quality, combined, 'Matches: ' || array_to_string(hits_list[1:4], ', ') || CASE WHEN len(hits_list) > 4 THEN ', +' || (len(hits_list) - 4) || ' more' ELSE '' END AS why FROM ({_ranked_sql(_WORDS)})""",
)
def rank_catalog(spark, d):
    rows = search.rank_catalog(catalog(spark, d), "The " + " ".join(_WORDS), _featured(), _curated())
    return rows.select("id", F.col("hits").cast("bigint").alias("hits"), "quality", F.round("combined", 6).alias("combined"), "why")


@query(
    "browse_reasons",
    f"""SELECT id, CASE WHEN featured THEN 'Featured explore example with verified analysis path.' WHEN hint >= 1000 THEN 'Large sample size — well suited for statistical analysis.' END AS why FROM ({_CATALOG})""",
)
def browse_reasons(spark, d):
    return search.rank_catalog(catalog(spark, d), "", _featured(), _curated()).select("id", "why")


@query(
    "search_page",
    f"""WITH r AS (SELECT * FROM ({_ranked_sql(['water', 'school'])}) WHERE ingestible AND portal = 'world_bank'),
            p AS (SELECT *, row_number() OVER (ORDER BY combined DESC, quality DESC, title DESC, id) AS position, (SELECT count(*) FROM r) AS total FROM r)
        SELECT position, id, total FROM p WHERE position BETWEEN 11 AND 20""",
)
def search_page(spark, d):
    rows = search.search_page(catalog(spark, d), "water school", portal="world_bank", page=2, limit=10, featured=_featured(), curated=_curated())
    return rows.select(F.col("position").cast("bigint").alias("position"), "id", "total")


def _theme_sql():
    parts = []
    for theme, spec in rules.THEMES.items():
        keys = " + ".join(
            f"(CASE WHEN contains(lower(title), '{k}') THEN 2 WHEN contains(body, '{k}') THEN 1 ELSE 0 END)" for k in spec["keywords"]
        )
        tags = ", ".join(f"'{x.lower()}'" for x in spec["tags"])
        parts.append(f"SELECT id, ingestible, '{theme}' AS theme, (CASE WHEN lower(tag) IN ({tags}) THEN 3 ELSE 0 END) + {keys} AS score FROM b")
    return (
        f"WITH b AS (SELECT *, lower(description || ' ' || search_text || ' ' || CASE WHEN id % 9 = 0 THEN ' health ' ELSE tag END) AS body FROM ({_CATALOG})), s AS ("
        + " UNION ALL ".join(parts) + ") "
    )


@query(
    "classify_themes",
    _theme_sql() + "SELECT c.id, coalesce(string_agg(theme, '|' ORDER BY score DESC, theme) FILTER (score >= 1), '') AS themes FROM s c GROUP BY 1",
)
def classify_themes(spark, d):
    return search.classify_themes(catalog(spark, d)).select("id", F.array_join("themes", "|").alias("themes"))


def paths(spark, d):
    """Curated paths from parts: one per brand and key block, with its names as patterns and its parts as members."""
    topics = list(rules.THEMES)
    block = F.expr("p_partkey div 50000").cast("string")
    p = t(spark, d, "part").withColumn("p_brand", F.concat("p_brand", F.lit("/"), block))
    brand_no = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    topic = F.element_at(F.array(*[F.lit(x) for x in topics]), (brand_no % 5 + 1).cast("int"))
    return p.groupBy("p_brand").agg(
        F.first(topic).alias("topic"), F.first(F.when(brand_no % 3 == 0, "verified").when(brand_no % 3 == 1, "good").otherwise("draft")).alias("quality"),
        F.array_sort(F.collect_set("p_name")).alias("patterns"), F.array_sort(F.collect_set("p_partkey")).alias("resource_ids"),
        F.min("p_size").alias("smallest"),
    ).select(
        F.col("p_brand").alias("path_id"), F.concat(F.lit("Small ring of "), "p_brand").alias("title"), "topic", "quality",
        F.concat(F.lit("Compare widget sizes from "), F.col("smallest").cast("string")).alias("description"), "patterns",
        "resource_ids",
    )


_BLOCKS = "(SELECT * REPLACE (p_brand || '/' || (p_partkey // 50000) AS p_brand) FROM part)"
_PATHS = f"""SELECT p_brand AS path_id, 'Small ring of ' || p_brand AS title, 'Compare widget sizes from ' || min(p_size) AS description,
  [{", ".join(f"'{x}'" for x in rules.THEMES)}][regexp_extract(p_brand, '(\\d+)', 1)::INT % 5 + 1] AS topic,
  CASE regexp_extract(p_brand, '(\\d+)', 1)::INT % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'good' ELSE 'draft' END AS quality FROM {_BLOCKS} GROUP BY p_brand"""
_WEIGHT = "CASE quality WHEN 'verified' THEN 0.5 WHEN 'good' THEN 0.25 ELSE 0.1 END"


@query(
    "theme_counts",
    _theme_sql() + f""", f AS (SELECT id, arg_min(theme, (-score, theme)) AS theme FROM s WHERE score >= 1 AND ingestible GROUP BY 1),
      th AS (SELECT unnest([{", ".join(f"'{x}'" for x in rules.THEMES)}]) AS theme)
      SELECT th.theme, (SELECT count(*) FROM f WHERE f.theme = th.theme) AS dataset_count, (SELECT count(*) FROM ({_PATHS}) p WHERE p.topic = th.theme) AS path_count FROM th""",
)
def theme_counts(spark, d):
    return search.theme_counts(catalog(spark, d), paths(spark, d)).drop("title")


_QUESTION = "how does the red widget compare with a small ring"
_Q_TOKENS = text.tokenize(_QUESTION)


@query(
    "match_paths",
    f"""WITH p AS ({_PATHS}), n AS (SELECT DISTINCT p_brand, p_name FROM {_BLOCKS}),
         k AS (SELECT p_brand, sum(CASE WHEN contains('{_QUESTION}', lower(p_name)) THEN 1.5 ELSE 0 END
               + 0.35 * len(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda w: w IN ({", ".join(f"'{w}'" for w in _Q_TOKENS)}))))) AS s FROM n GROUP BY 1),
         x AS (SELECT path_id, quality, {_WEIGHT} AS w, k.s + {" + ".join(f"(CASE WHEN contains(lower(title), '{w}') OR contains(lower(description), '{w}') THEN 0.2 ELSE 0 END)" for w in _Q_TOKENS)} AS s FROM p JOIN k ON k.p_brand = p.path_id)
       SELECT path_id, quality, round(s + w, 6) AS score FROM x ORDER BY round(s + w, 6) DESC, w DESC, path_id LIMIT 5""",
)
def match_paths(spark, d):
    return search.match_paths(paths(spark, d), _QUESTION).select("path_id", "quality", "score")


@query(
    "valid_curated_paths",
    f"""SELECT path_id, title, quality FROM ({_PATHS}) WHERE topic = 'health' AND path_id IN (SELECT p_brand FROM {_BLOCKS} GROUP BY 1 HAVING count(*) = count(*) FILTER (p_retailprice < 1090 OR NOT starts_with(p_brand, 'Brand#1/')))""",
)
def valid_curated_paths(spark, d):
    available = t(spark, d, "part").select(
        F.col("p_partkey").alias("id"), ((F.col("p_retailprice") < 1090) | (F.col("p_brand") != "Brand#1")).alias("ingestible")
    )
    return search.curated_paths(paths(spark, d), available, "health").select("path_id", "title", "quality")


@query(
    "complete_members",
    f"""SELECT p_brand AS path_id FROM {_BLOCKS} GROUP BY 1 HAVING count(*) = count(*) FILTER (p_size > 1)""",
)
def complete_members(spark, d):
    ids = t(spark, d, "part").where("p_size > 1").select(F.col("p_partkey").alias("id"))
    return joins.complete_members(paths(spark, d), ids).select("path_id")


@query("suggest_for_question")
def suggest_for_question(spark, d):
    parts = t(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.lit("data_gov").alias("portal"), F.col("p_name").alias("title"), F.col("p_type").alias("description"),
        F.array("p_brand").alias("tags"), F.lit("csv").alias("format"), (F.col("p_size") * 100).alias("row_count_hint"),
        F.array(F.struct(F.lit("a").alias("name"))).alias("columns"), F.lit(True).alias("ingestible"), F.lower("p_name").alias("search_text"),
    )
    return search.suggest(paths(spark, d), parts, _QUESTION)


@query(
    "without_used_ids",
    "SELECT p_partkey AS id, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)",
)
def without_used_ids(spark, d):
    used = t(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("id"))
    return joins.without_used(t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name"), used)


@query(
    "batch_lookup",
    """SELECT l_orderkey AS request, l_partkey AS id, p_name, CASE WHEN p_size <= 10 THEN 'Dataset not available for analysis: ' || l_partkey END AS error, count(*) AS n
       FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL
       UNION ALL SELECT l_orderkey, -1, NULL, 'Unknown resource: -1', count(*) FROM lineitem GROUP BY 1""",
)
def batch_lookup(spark, d):
    """Each line of an order asks for its part and for an id that does not exist."""
    asked = t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("request"), F.array(F.col("l_partkey"), F.lit(-1).cast("bigint")).alias("ids")
    )
    parts = t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", (F.col("p_size") > 10).alias("ingestible"))
    rows = joins.batch_lookup(asked, parts)
    return rows.groupBy("request", "id", "p_name", "error").agg(F.count(F.lit(1)).alias("n"))


@query(
    "enrich_with_dimension",
    """SELECT coalesce(c_mktsegment, 'unknown') AS segment, coalesce(c_name, user_id::VARCHAR) AS title, count(*) AS n FROM events LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = user_id GROUP BY ALL""",
)
def enrich_with_dimension(spark, d):
    dim = t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("title"))
    rows = joins.with_dimension(
        t(spark, d, "events").select("user_id"), dim, "user_id", {"segment": F.lit("unknown"), "title": F.col("user_id").cast("string")}
    )
    return rows.groupBy("segment", "title").agg(F.count(F.lit(1)).alias("n"))


@query(
    "code_lookups",
    """SELECT event_type, CASE event_id % 100 """ + " ".join(f"WHEN {k} THEN '{v}'" for k, v in rules.WEATHER_CODES.items()) + """ ELSE 'See details' END AS condition,
       CASE event_type WHEN 'view' THEN 'Brooklyn' WHEN 'click' THEN 'Queens' WHEN 'purchase' THEN 'Manhattan' END AS borough, count(*) AS n FROM events GROUP BY ALL""",
)
def code_lookups(spark, d):
    area = F.when(F.col("event_type") == "view", "dumbo").when(F.col("event_type") == "click", "astoria").when(F.col("event_type") == "purchase", "soho").otherwise("elsewhere")
    rows = t(spark, d, "events").select(
        "event_type", joins.code_lookup((F.col("event_id") % 100).cast("int"), rules.WEATHER_CODES, "See details").alias("condition"),
        joins.code_lookup(area, rules.AREA_TO_BOROUGH).alias("borough"),
    )
    return rows.groupBy("event_type", "condition", "borough").agg(F.count(F.lit(1)).alias("n"))


@query(
    "catalog_health",
    f"""WITH c AS ({_CATALOG})
        SELECT 'portal' AS section, portal AS label, count(*) AS total, count(*) FILTER (ingestible) AS ingestible, count(*) FILTER (NOT ingestible) AS blocked FROM c GROUP BY portal
        UNION ALL SELECT 'all', 'all', count(*), count(*) FILTER (ingestible), count(*) FILTER (NOT ingestible) FROM c
        UNION ALL SELECT * FROM (SELECT 'reason', coalesce(reason, 'unknown') AS r, count(*) AS n, 0, count(*) FROM c WHERE NOT ingestible GROUP BY r ORDER BY n DESC, r LIMIT 10)""",
)
def catalog_health(spark, d):
    return metrics.catalog_health(catalog(spark, d))
