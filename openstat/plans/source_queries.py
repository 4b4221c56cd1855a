"""Registered queries: scans, paging, probes, sinks, catalog upkeep and text rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from openstat import rules
from openstat.functions import licensing, text
from openstat.operators import joins
from openstat.plans.registry import query
from openstat.session import read_table as t, shared_dir
from openstat.sources import catalog_sync, paging, probe, scan, sinks


def _scratch(spark, name):
    """A new folder under the shared folder for files a query writes and reads back."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- scans -----------------------------------------------------------------------------


@query(
    "scan_csv",
    """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price, max(l_linenumber) AS max_line FROM lineitem GROUP BY 1""",
)
def scan_csv(spark, d):
    path = _scratch(spark, "csv")
    t(spark, d, "lineitem").write.option("header", True).csv(path)
    rows = scan.read_csv(spark, path)
    return rows.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"), F.max("l_linenumber").alias("max_line"),
    )


@query(
    "scan_json_shapes",
    "SELECT c_nationkey, count(*) AS n, sum(c_custkey)::BIGINT AS keys, count(*) FILTER (c_custkey % 3 = 0) AS marked FROM customer GROUP BY 1",
)
def scan_json_shapes(spark, d):
    """A folder whose files are lists, [meta, rows] envelopes, empty envelopes and single objects."""
    path = _scratch(spark, "shapes")
    c = t(spark, d, "customer").select(
        F.floor(F.col("c_custkey") / 200).alias("file"),  # a document holds at most 200 rows
        F.to_json(F.struct("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, 1).alias("mark"))).alias("r"),
    )
    rows = F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]"))
    docs = c.groupBy("file").agg(rows.alias("rows"), F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("n") == 1, F.expr("substring(rows, 2, length(rows) - 2)"))
        .when(F.col("file") % 2 == 0, F.concat(F.lit('[{"page": 1}, '), "rows", F.lit("]")))
        .otherwise(F.col("rows")).alias("value"), "file",
    )
    docs.write.partitionBy("file").text(path)
    spark.createDataFrame([('[{"page": 1}, []]', -1)], "value string, file int").write.partitionBy("file").mode("append").text(path)
    return scan.read_records(spark, path).groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"), F.count("mark").alias("marked")
    )


@query(
    "scan_json_union_of_keys",
    """SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS k_sum, count(*) FILTER (event_id % 997 = 0) AS late_keys FROM events GROUP BY 1""",
)
def scan_json_union_of_keys(spark, d):
    """JSON lines where a key shows up only in a few late rows."""
    path = _scratch(spark, "json")
    e = t(spark, d, "events").select(
        "event_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.when(F.col("event_id") % 997 == 0, F.col("user_id")).alias("late"),
    )
    e.write.json(path)
    rows = scan.read_records(spark, path, lines=True)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k_sum"), F.count("late").alias("late_keys"))


@query("parse_json_objects", "SELECT event_id, event_type, (props->>'k')::BIGINT AS k FROM events")
def parse_json_objects(spark, d):
    return scan.from_json_objects(t(spark, d, "events").select("event_id", "event_type", "props"), "props")


@query(
    "flatten_indicator",
    """SELECT CASE WHEN n_nationkey % 4 = 0 THEN printf('N%02d', n_nationkey) ELSE upper(left(n_name, 3)) END AS countryiso3code, n_name AS country, 'IND' AS indicator_id,
              'Order value' AS indicator, year(o_orderdate)::VARCHAR AS date, round(avg(o_totalprice), 6) AS value
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
)
def flatten_indicator(spark, d):
    """Yearly means per nation written as nested indicator records, with and without a code."""
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    per_year = o.groupBy("n_nationkey", "n_name", F.year("o_orderdate").cast("string").alias("date")).agg(F.avg("o_totalprice").alias("v"))
    code = F.when(F.col("n_nationkey") % 4 != 0, F.upper(F.left("n_name", F.lit(3)))).otherwise("")
    record = F.to_json(F.struct(
        F.struct(F.lit("IND").alias("id"), F.lit("Order value").alias("value")).alias("indicator"),
        F.struct(F.format_string("N%02d", "n_nationkey").alias("id"), F.col("n_name").alias("value")).alias("country"),
        code.alias("countryiso3code"), F.col("date"), F.struct(F.col("v").alias("value")).alias("value"),
    ))
    rows = scan.flatten_indicator(per_year.select(record.alias("record")), "record")
    return rows.withColumn("value", F.round("value", 6))


@query(
    "flatten_observations",
    """SELECT CASE WHEN user_id % 2 = 0 THEN 'U' || user_id ELSE 'Q' || user_id END AS series_id, strftime(ts, '%Y-%m-%d') AS date, count(*) AS n, round(sum(value), 2) AS value
       FROM events WHERE event_id % 7 NOT IN (0, 1, 2) GROUP BY ALL""",
)
def flatten_observations(spark, d):
    """One payload per user, day and key block; dots, blanks and words are dropped."""
    k = F.col("event_id") % 7
    raw = F.when(k == 0, ".").when(k == 1, "").when(k == 2, "n/a").otherwise(F.col("value").cast("string"))
    block = F.expr("event_id div 50000").alias("block")
    e = t(spark, d, "events").select("user_id", block, F.date_format("ts", "yyyy-MM-dd").alias("date"), raw.alias("value"))
    payloads = e.groupBy("user_id", "date", "block").agg(
        F.to_json(F.struct(F.collect_list(F.struct("date", "value")).alias("observations"))).alias("payload")
    )
    rows = scan.flatten_observations(
        payloads, "payload", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("fred:U"), F.col("user_id").cast("string"))).otherwise(""),
        F.concat(F.lit("https://example.org/obs?x=1&series_id=Q"), F.col("user_id").cast("string")),
    )
    return rows.groupBy("series_id", "date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))


# --- paging -----------------------------------------------------------------------------


@query(
    "assemble_chunks",
    """WITH r AS (SELECT o_orderkey // 1000 AS chunk, o_orderkey AS pos FROM orders), c AS (SELECT DISTINCT chunk FROM r),
       bad AS (SELECT coalesce(min(chunk) FILTER (chunk % 10 = 9), max(chunk) + 1) AS b FROM c)
       SELECT count(*) AS n, max(pos) AS last_pos FROM (SELECT r.* FROM r, bad WHERE chunk < b ORDER BY chunk, pos LIMIT 8500)""",
)
def assemble_chunks(spark, d):
    """Orders in chunks of a thousand keys; every tenth chunk failed."""
    rows = t(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 1000).alias("chunk"), F.col("o_orderkey").alias("pos"))
    chunks = rows.select("chunk").distinct().withColumn("ok", F.col("chunk") % 10 != 9)
    return paging.assemble_chunks(rows, chunks, 8500).agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last_pos"))


@query(
    "assemble_pages",
    """WITH r AS (SELECT o_orderstatus AS source, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) AS i, o_orderkey FROM orders),
            p AS (SELECT source, o_orderkey // 1500 + 1 AS page, i, o_orderkey FROM r),
            tot AS (SELECT source, count(*) AS total, max(page) AS pages FROM p GROUP BY 1),
            bad AS (SELECT source, min(page) AS b FROM (SELECT DISTINCT source, page FROM p) WHERE source = 'F' AND page = 5 GROUP BY 1)
       SELECT p.source, count(*) AS n, max(o_orderkey) AS last_key FROM p JOIN tot USING (source) LEFT JOIN bad USING (source)
       WHERE i < least(4000, total) AND (b IS NULL OR page < b) GROUP BY 1""",
)
def assemble_pages(spark, d):
    """Orders of each status in pages of 1 500 keys; page 5 of one source failed."""
    from pyspark.sql import Window as W

    rows = t(spark, d, "orders").select(
        F.col("o_orderstatus").alias("source"), (F.floor(F.col("o_orderkey") / 1500) + 1).alias("page"), "o_orderkey"
    )
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("source", "page").orderBy("o_orderkey")) - 1)
    totals = rows.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.max("page").alias("pages"))
    pages = rows.select("source", "page").distinct().join(totals, "source").withColumn(
        "ok", ~((F.col("source") == "F") & (F.col("page") == 5))
    )
    out = paging.assemble_pages(rows, pages, 4000)
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key"))


@query(
    "trim_to_bytes",
    """WITH s AS (SELECT doc_id, octet_length(encode(lang)) + octet_length(encode(source)) + len(doc_id::VARCHAR) + len(n_chars::VARCHAR) + len('{"doc_id":,"lang":"","source":"","n_chars":}') + 1 AS b FROM documents),
            c AS (SELECT doc_id, sum(b) OVER (ORDER BY doc_id) AS run FROM s)
       SELECT count(*) AS n, max(doc_id) AS last_doc FROM c WHERE run + 1 <= 40000""",
)
def trim_to_bytes(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return paging.trim_to_bytes(docs, "doc_id", 40_000).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last_doc"))


# --- probes -----------------------------------------------------------------------------


def _block():
    """Payloads hold one customer's orders of one key block, so none grows with the table."""
    return F.expr("o_orderkey div 50000").alias("block")


def _payloads(spark, d):
    """Web pages, event properties, document texts, and CSV and JSON tables built from orders."""
    pages = t(spark, d, "pages").select(F.lit("page").alias("family"), F.col("page_id").cast("string").alias("id"), F.col("html").alias("payload"))
    props = t(spark, d, "events").select(F.lit("props"), F.col("event_id").cast("string"), "props")
    docs = t(spark, d, "documents").select(
        F.lit("zip"), F.col("doc_id").cast("string"), F.concat(F.lit("PK"), "text")
    )
    o = t(spark, d, "orders").groupBy("o_custkey", _block()).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"))).alias("rows"))
    line = F.transform("rows", lambda r: F.concat_ws(",", r["o_orderkey"].cast("string"), r["o_orderstatus"]))
    csv = o.select(F.lit("csv"), F.col("o_custkey").cast("string"), F.concat(F.lit("order_key,status\n"), F.array_join(line, "\n")))
    records = o.select(F.lit("json"), F.col("o_custkey").cast("string"), F.to_json("rows"))
    out = pages
    for part in (props, docs, csv, records):
        out = out.union(part)
    return out.withColumn("url", F.concat(F.lit("https://example.org/"), "id"))


@query(
    "probe_payloads",
    """WITH c AS (SELECT o_custkey, o_orderkey // 50000 AS block, count(*) AS n FROM orders GROUP BY 1, 2)
       SELECT 'page' AS family, 'HTML' AS detected_format, FALSE AS ingestible, 'HTML page, not a data file' AS reason, count(*) AS n FROM pages
       UNION ALL SELECT 'props', 'JSON_NESTED', FALSE, 'need at least 2 columns for analysis', count(*) FROM events
       UNION ALL SELECT 'zip', 'ZIP', FALSE, 'ZIP archive — unpack not supported yet', count(*) FROM documents
       UNION ALL SELECT 'csv', CASE WHEN n >= 20 THEN 'CSV' END, n >= 20, CASE WHEN n >= 20 THEN 'CSV tabular file' ELSE 'CSV sample has ' || n || ' row(s) — need at least 20' END, count(*) FROM c GROUP BY ALL
       UNION ALL SELECT 'json', CASE WHEN n >= 20 THEN 'JSON_RECORDS' END, n >= 20, CASE WHEN n >= 20 THEN 'flat JSON records' ELSE 'JSON dataset has ' || n || ' row(s) — need at least 20' END, count(*) FROM c GROUP BY ALL""",
)
def probe_payloads(spark, d):
    rows = probe.probe_payloads(_payloads(spark, d), "payload", "url")
    return rows.groupBy("family", "detected_format", "ingestible", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "probe_indicator_envelope",
    """SELECT n >= 20 AS ingestible, CASE WHEN n >= 20 THEN 'World Bank API (' || n || ' observations)' ELSE 'World Bank indicator has ' || n || ' row(s) — need at least 20' END AS reason, count(*) AS n
       FROM (SELECT o_custkey, o_orderkey // 50000 AS block, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY ALL""",
)
def probe_indicator_envelope(spark, d):
    o = t(spark, d, "orders").groupBy("o_custkey", _block()).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("value"))).alias("rows"))
    payload = F.concat(F.lit('[{"total":'), F.size("rows").cast("string"), F.lit("},"), F.to_json("rows"), F.lit("]"))
    rows = probe.probe_indicator_envelope(o.select(payload.alias("payload")), "payload")
    return rows.groupBy("ingestible", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "probe_series",
    """SELECT CASE WHEN user_id % 10 = 0 THEN FALSE ELSE n >= 20 END AS ingestible,
              CASE WHEN user_id % 10 = 0 THEN 'Bad Request' WHEN n >= 20 THEN 'FRED observations (' || n || ' points)' ELSE 'FRED series has ' || n || ' row(s) — need at least 20' END AS reason, count(*) AS n
       FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) GROUP BY ALL""",
)
def probe_series(spark, d):
    e = t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("c"))
    payload = F.when(F.col("user_id") % 10 == 0, F.lit('{"error_code":400,"error_message":"Bad Request"}')).otherwise(
        F.format_string('{"count":%d,"observations":[]}', "c")
    )
    rows = probe.probe_series(e.select(payload.alias("payload")), "payload")
    return rows.groupBy("ingestible", "reason").agg(F.count(F.lit(1)).alias("n"))


def _links(spark, d):
    """Two links per page: one by suffix, one by declared type."""
    k = F.col("page_id") % 5
    suffix = F.when(k == 0, ".csv").when(k == 1, ".json").when(k == 2, ".zip").when(k == 3, "/download").otherwise("")
    plain = F.regexp_replace("url", r"[?#].*$", "")
    p = t(spark, d, "pages")
    first = p.select(
        F.col("page_id").alias("id"), F.lit(0).alias("position"), F.concat(plain, suffix).alias("download_url"),
        F.lit(None).cast("string").alias("access_url"), F.lit(None).cast("string").alias("format"), F.lit(None).cast("string").alias("media_type"),
    )
    media = F.when(k == 0, "text/html").when(k == 1, "text/csv").when(k == 2, "application/json").when(k == 3, "text/tab-separated-values").otherwise("")
    second = p.select(
        F.col("page_id").alias("id"), F.lit(1).alias("position"), F.lit("").alias("download_url"), plain.alias("access_url"),
        F.lit("").alias("format"), media.alias("media_type"),
    )
    return first.unionByName(second)


_LINK_SQL = r"""WITH p AS (SELECT page_id AS id, regexp_replace(url, '[?#].*$', '') AS u, page_id % 5 AS k FROM pages),
  l AS (SELECT id, 0 AS position, u || CASE k WHEN 0 THEN '.csv' WHEN 1 THEN '.json' WHEN 2 THEN '.zip' WHEN 3 THEN '/download' ELSE '' END AS url, TRUE AS dl, '' AS fmt FROM p
        UNION ALL SELECT id, 1, u, FALSE, CASE k WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/csv' WHEN 2 THEN 'application/json' WHEN 3 THEN 'text/tab-separated-values' ELSE '' END FROM p),
  s AS (SELECT *, CASE WHEN dl THEN 25 ELSE 0 END + CASE WHEN url LIKE '%.csv' THEN 50 ELSE 0 END + CASE WHEN url LIKE '%.json' THEN 45 ELSE 0 END
     + CASE WHEN fmt LIKE '%csv%' OR lower(url) LIKE '%/csv%' THEN 40 ELSE 0 END + CASE WHEN fmt LIKE '%json%' THEN 35 ELSE 0 END + CASE WHEN url LIKE '%.tsv' OR fmt LIKE '%tab-separated%' THEN 30 ELSE 0 END
     - CASE WHEN """ + " OR ".join(f"contains(lower(url), '{e}')" for e in rules.BLOCKED_EXTENSIONS) + r""" THEN 60 ELSE 0 END
     - CASE WHEN NOT regexp_matches(lower(url), '\.(csv|json|tsv|txt)$') AND len(url) - len(replace(url, '/', '')) <= 4 AND NOT contains(lower(url), 'download') AND NOT contains(lower(url), 'api/') THEN 35 ELSE 0 END AS score,
     CASE WHEN fmt LIKE '%csv%' OR lower(url) LIKE '%.csv' THEN 'CSV' WHEN fmt LIKE '%json%' OR lower(url) LIKE '%.json' THEN 'JSON' WHEN fmt <> '' THEN left(upper(split_part(fmt, '/', -1)), 32) ELSE 'UNKNOWN' END AS format_hint FROM l)
  SELECT id, url, format_hint, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, position) AS r FROM s) WHERE r = 1"""


@query("rank_links", _LINK_SQL)
def rank_links(spark, d):
    return probe.rank_links(_links(spark, d)).select("id", "url", "format_hint", "score")


@query("format_hints", _LINK_SQL.replace("SELECT id, url, format_hint, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, position) AS r FROM s) WHERE r = 1", "SELECT format_hint, count(*) AS n FROM s GROUP BY 1"))
def format_hints(spark, d):
    rows = probe.rank_links(_links(spark, d), keep=None)
    return rows.groupBy("format_hint").agg(F.count(F.lit(1)).alias("n"))


# --- sinks and upkeep ----------------------------------------------------------------------


@query("replace_table", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def replace_table(spark, d):
    """Write a table twice; the second write replaces the first."""
    path = _scratch(spark, "table")
    sinks.replace_table(t(spark, d, "nation"), path)
    stored = sinks.replace_table(t(spark, d, "orders"), path)
    return stored.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("write_results", "SELECT s_nationkey::BIGINT AS s_nationkey, count(*) AS n FROM supplier GROUP BY 1")
def write_results(spark, d):
    folder = _scratch(spark, "results")
    table = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_results({"by_nation": table}, folder)
    return sinks.read_results(spark, folder, "by_nation")


@query(
    "catalog_upsert",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN round(c_acctbal + 1000, 2) ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 3 = 0 THEN 'UPDATED' ELSE c_mktsegment END AS segment FROM customer
       UNION ALL SELECT 1000000 + s_suppkey, s_acctbal, 'NEW' FROM supplier""",
)
def catalog_upsert(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    changed = c.where("id % 3 = 0").select("id", F.round(F.col("balance") + 1000, 2).alias("balance"), F.lit("UPDATED").alias("segment"))
    added = t(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("id"), F.col("s_acctbal").alias("balance"), F.lit("NEW").alias("segment"))
    return catalog_sync.upsert(c, changed.unionByName(added))


@query(
    "prune_stale_rows",
    "SELECT source AS portal, count(*) AS n FROM documents WHERE source <> 'src3' OR lang = 'en' OR NOT starts_with(lang || ':' || doc_id, 'f') GROUP BY 1",
)
def prune_stale_rows(spark, d):
    """Documents as catalog rows: a pass over one source saw only its English rows; other-language ids may go."""
    rows = t(spark, d, "documents").select(F.concat_ws(":", "lang", F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("portal"), "lang")
    seen = rows.where("portal = 'src3' and lang = 'en'")
    return catalog_sync.prune_stale(rows, seen, "src3", "f").groupBy("portal").agg(F.count(F.lit(1)).alias("n"))


@query(
    "apply_probe_results",
    """SELECT ingestible, ingest_block_reason, detected_format, row_count_hint, n_columns, count(*) AS n FROM (
         SELECT CASE page_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE FALSE END AS ingestible, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'CSV has no data rows' ELSE 'pending probe' END AS ingest_block_reason,
                CASE page_id % 3 WHEN 0 THEN 'CSV' WHEN 1 THEN 'EMPTY' ELSE 'UNKNOWN' END AS detected_format, CASE page_id % 3 WHEN 0 THEN 100 + page_id % 4 ELSE 7 END AS row_count_hint, CASE page_id % 3 WHEN 0 THEN 50 ELSE 1 END AS n_columns FROM pages) GROUP BY ALL""",
)
def apply_probe_results(spark, d):
    p = t(spark, d, "pages")
    catalog = p.select(
        F.col("page_id").alias("id"), F.lit(False).alias("ingestible"), F.lit("pending probe").alias("ingest_block_reason"),
        F.lit("UNKNOWN").alias("detected_format"), F.lit(7).cast("bigint").alias("row_count_hint"),
        F.array(F.struct(F.lit("a").alias("name"))).alias("columns"), F.lit(None).cast("timestamp").alias("probed_at"),
    )
    k = F.col("page_id") % 3
    names = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("c"), i.cast("string")))
    probes = p.where(k < 2).select(
        F.col("page_id").alias("id"), (k == 0).alias("ingestible"), F.when(k == 1, "CSV has no data rows").otherwise("ok").alias("reason"),
        F.when(k == 0, "CSV").otherwise("EMPTY").alias("detected_format"), F.when(k == 0, names).alias("columns"),
        F.when(k == 0, 100 + F.col("page_id") % 4).alias("row_count"),
    )
    rows = catalog_sync.apply_probe(catalog, probes)
    return rows.groupBy(
        "ingestible", "ingest_block_reason", "detected_format", "row_count_hint", F.size("columns").alias("n_columns")
    ).agg(F.count(F.lit(1)).alias("n"))


def _license_field():
    k = F.col("doc_id") % 8
    return (
        F.when(k == 0, "CC0-1.0").when(k == 1, "https://www.usa.gov/government-works").when(k == 2, " us-pd ")
        .when(k == 3, "Creative Commons Attribution 4.0").when(k == 4, "").when(k == 5, "All rights reserved")
        .when(k == 6, "Public Domain Mark").otherwise("https://creativecommons.org/publicdomain/zero/1.0/")
    )


_LICENSE_CASE = """CASE doc_id % 8 WHEN 0 THEN 'CC0' WHEN 1 THEN 'US_GOV_WORK' WHEN 2 THEN 'US_PD' WHEN 3 THEN 'CC_BY' WHEN 6 THEN 'US_PD' WHEN 7 THEN 'CC0' END"""


@query(
    "license_gate",
    f"""SELECT license, portal, license IS NOT NULL AND (license <> 'CC_BY' OR portal = 'world_bank') AS allowed, coalesce(license = 'CC_BY', FALSE) AS attribution, count(*) AS n
        FROM (SELECT {_LICENSE_CASE} AS license, CASE WHEN lang = 'en' THEN 'world_bank' ELSE 'data_gov' END AS portal FROM documents) GROUP BY ALL""",
)
def license_gate(spark, d):
    rows = t(spark, d, "documents").select(
        licensing.normalize_license(_license_field()).alias("license"), F.when(F.col("lang") == "en", "world_bank").otherwise("data_gov").alias("portal")
    )
    return rows.groupBy(
        "license", "portal", licensing.license_allowed(F.col("license"), F.col("portal")).alias("allowed"),
        licensing.attribution_required(F.col("license")).alias("attribution"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "license_from_record",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'CC0-1.0' WHEN contains(lower(text), 'cc0') OR contains(lower(text), 'creative commons zero') THEN 'https://creativecommons.org/publicdomain/zero/1.0/'
              WHEN contains(lower(text), 'public domain') AND contains(replace(lower(text), ' ', ''), '17usc') THEN 'https://www.usa.gov/publicdomain/label/1.0/' END AS license FROM (
         SELECT doc_id, text || CASE doc_id % 4 WHEN 1 THEN ' Released under CC0.' WHEN 2 THEN ' Public domain, 17 USC 105.' ELSE '' END AS text FROM documents)""",
)
def license_from_record(spark, d):
    k = F.col("doc_id") % 4
    body = F.concat("text", F.when(k == 1, " Released under CC0.").when(k == 2, " Public domain, 17 USC 105.").otherwise(""))
    return t(spark, d, "documents").select("doc_id", licensing.license_of_record(F.when(k == 0, " CC0-1.0 "), body).alias("license"))


@query(
    "attribution_texts",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'The World Bank: Doc ' || doc_id || ': ' || source || '. Source: u' || doc_id || '. Licensed under CC BY 4.0.'
         WHEN 1 THEN 'Source: Doc ' || doc_id || '. Retrieved from FRED, Federal Reserve Bank of St. Louis; u' || doc_id || '.' WHEN 2 THEN 'Source: NYC Open Data — Doc ' || doc_id || '. u' || doc_id ELSE 'Source: ' || source || '. u' || doc_id END AS attribution FROM documents""",
)
def attribution_texts(spark, d):
    k = F.col("doc_id") % 4
    portal = F.when(k == 0, "world_bank").when(k == 1, "fred").when(k == 2, "nyc_open_data").otherwise("data_gov")
    key = F.col("doc_id").cast("string")
    return t(spark, d, "documents").select(
        "doc_id", licensing.attribution_text(portal, F.concat(F.lit("Doc "), key), F.col("source"), F.concat(F.lit("u"), key)).alias("attribution")
    )


_CUT = """CASE WHEN octet_length(encode(full_text)) <= 2500 THEN full_text ELSE regexp_replace(decode(unhex(substr(hex(encode(full_text)), 1, 2 * (CASE
  WHEN NOT (substr(hex(encode(full_text)), 5001, 2) BETWEEN '80' AND 'BF') THEN 2500 WHEN NOT (substr(hex(encode(full_text)), 4999, 2) BETWEEN '80' AND 'BF') THEN 2499
  WHEN NOT (substr(hex(encode(full_text)), 4997, 2) BETWEEN '80' AND 'BF') THEN 2498 ELSE 2497 END)))), '\\s+$', '') END""".replace("\\\\", "\\")


@query(
    "search_text",
    f"""SELECT doc_id, md5({_CUT}) AS digest, octet_length(encode({_CUT})) AS bytes FROM (
         SELECT doc_id, lower('Document ' || doc_id || ' ' || text || ' ' || source || ' ' || lang || ' text') AS full_text FROM documents)""",
)
def search_text(spark, d):
    blob = text.search_text(
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")), F.col("text"), F.col("source"), F.array(F.col("lang"), F.lit("text"))
    )
    return t(spark, d, "documents").select("doc_id", F.md5(blob).alias("digest"), F.octet_length(blob).cast("bigint").alias("bytes"))


@query(
    "redact_secrets",
    """SELECT doc_id, 'https://h/q?api_key=REDACTED&q=' || source || ' token=REDACTED x=' || lang AS redacted FROM documents""",
)
def redact_secrets(spark, d):
    key = F.md5(F.col("text"))
    raw = F.concat(F.lit("https://h/q?api_key="), key, F.lit("&q="), "source", F.lit(" token="), key, F.lit(" x="), "lang")
    return t(spark, d, "documents").select("doc_id", text.redact_secrets(raw).alias("redacted"))


@query(
    "sanitize_summaries",
    r"""WITH l AS (SELECT doc_id, unnest(string_split_regex('# Heading' || chr(10) || 'Executive summary of it' || chr(10) || chr(10) || text || chr(10) || '  ## more', '\r\n|\n|\r')) AS line, generate_subscripts(string_split_regex('# Heading' || chr(10) || 'Executive summary of it' || chr(10) || chr(10) || text || chr(10) || '  ## more', '\r\n|\n|\r'), 1) AS i FROM documents),
            k AS (SELECT doc_id, string_agg(CASE WHEN trim(line) = '' THEN '' ELSE line END, chr(10) ORDER BY i) AS body FROM l WHERE NOT starts_with(trim(line), '#') AND NOT regexp_matches(trim(line), '(?i)^executive summary\b') GROUP BY 1)
       SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split_regex(body, '\n\s*\n'), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')), lambda b: b <> ''), chr(10) || chr(10))) AS digest FROM k""",
)
def sanitize_summaries(spark, d):
    raw = F.concat(F.lit("# Heading\nExecutive summary of it\n\n"), "text", F.lit("\n  ## more"))
    return t(spark, d, "documents").select("doc_id", F.md5(text.sanitize_summary(raw)).alias("digest"))


@query(
    "number_grounding",
    """WITH said AS (
         SELECT o_orderkey, o_totalprice AS price,
                round(o_totalprice * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1.005 ELSE 1.5 END, 2) AS quoted FROM orders),
       allowed AS (SELECT unnest(range(1, 26))::DOUBLE AS x UNION ALL SELECT 100.0)
       SELECT o_orderkey,
              abs(price - quoted) <= 0.01 * greatest(abs(price), abs(quoted), 1)
              OR (abs(round(price) - price) < 0.01 AND abs(round(price) - quoted) < 0.5)
              OR EXISTS (SELECT 1 FROM allowed WHERE abs(x - quoted) <= 0.01 * greatest(x, abs(quoted), 1) OR abs(x - quoted) < 0.5)
              AS grounded FROM said""",
)
def number_grounding(spark, d):
    """A summary that quotes the order value exactly, nearly, or half as much again."""
    k, price = F.col("o_orderkey") % 3, F.col("o_totalprice")
    quoted = F.when(k == 0, price).when(k == 1, price * 1.005).otherwise(price * 1.5)
    said = F.concat(F.lit("About "), F.format_string("%,.2f", quoted), F.lit(" across 12 groups."))
    return t(spark, d, "orders").select("o_orderkey", text.numbers_grounded(said, F.array(price)).alias("grounded"))


# --- portal records --------------------------------------------------------------------------


def _portal_docs(spark, d):
    return t(spark, d, "documents").withColumn("key", F.col("doc_id").cast("string"))


@query(
    "indicator_rows",
    """SELECT 'wb:' || doc_id AS id, 'Indicator ' || doc_id AS title, length(left(text, 2000)) AS description_length, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'World Bank' END AS organization,
              lang AS tags, 'CC_BY' AS license_normalized, TRUE AS attribution_required,
              'The World Bank: Indicator ' || doc_id || ': ' || CASE WHEN doc_id % 2 = 0 THEN source ELSE 'World Bank' END || '. Source: https://data.worldbank.org/indicator/' || doc_id || '. Licensed under CC BY 4.0.' AS attribution_text FROM documents""",
)
def indicator_rows(spark, d):
    records = _portal_docs(spark, d).select(
        F.col("key").alias("id"), F.concat(F.lit(" Indicator "), "key").alias("name_raw"), F.concat(F.lit("Indicator "), "key").alias("name"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("source_organization"),
        F.lit(None).cast("string").alias("source_name"), F.col("text").alias("source_note"), F.array(F.col("lang"), F.lit("")).alias("topics"),
    )
    rows = catalog_sync.indicator_rows(records)
    return rows.select(
        "id", "title", F.length("description").cast("bigint").alias("description_length"), "organization", F.array_join("tags", "|").alias("tags"),
        "license_normalized", "attribution_required", "attribution_text",
    )


@query(
    "dcat_rows",
    f"""SELECT 'datagov:' || doc_id AS id, {_LICENSE_CASE} AS license_normalized, source AS organization, 'https://catalog.data.gov/dataset/' || doc_id AS source_url,
               CASE {_LICENSE_CASE} WHEN 'CC0' THEN 'CC0 1.0 — public domain dedication' WHEN 'US_PD' THEN 'US Public Domain' WHEN 'US_GOV_WORK' THEN 'US Government Work' END AS license_display
        FROM documents WHERE lang <> 'de' AND {_LICENSE_CASE} IN ('CC0', 'US_PD', 'US_GOV_WORK')""",
)
def dcat_rows(spark, d):
    docs = _portal_docs(spark, d)
    records = docs.select(
        F.col("key").alias("slug"), F.concat(F.lit("Doc "), "key").alias("title"), F.lit("plain text").alias("description"), _license_field().alias("license"),
        F.when(F.col("lang") == "de", "non-public").otherwise("public").alias("access_level"), F.lit("").alias("organization"),
        F.col("source").alias("publisher"), F.array("lang").alias("keywords"), F.lit(None).cast("string").alias("landing_page"),
    )
    return catalog_sync.dcat_rows(records).select("id", "license_normalized", "organization", "source_url", "license_display")


@query(
    "series_rows",
    """SELECT 'fred:' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR ELSE 'Series ' || doc_id END AS title, lang AS tags, 'https://fred.stlouisfed.org/series/' || doc_id AS source_url
       FROM documents WHERE NOT contains(lower(left(text, 2000)), 'copyright')""",
)
def series_rows(spark, d):
    records = _portal_docs(spark, d).select(
        F.col("key").alias("id"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("Series "), "key")).alias("title"), F.col("text").alias("notes"),
        F.col("lang").alias("frequency"), F.lit("").alias("units"), F.lit("https://example.org").alias("resource_url"),
    )
    return catalog_sync.series_rows(records).select("id", "title", F.array_join("tags", "|").alias("tags"), "source_url")


@query(
    "view_rows",
    """SELECT 'nyc:' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'NYC Open Data' END AS organization, least(50, doc_id % 70) AS n_columns,
              'Source: NYC Open Data — View ' || doc_id || '. https://data.cityofnewyork.us/d/' || doc_id AS attribution_text FROM documents WHERE doc_id % 5 <> 0""",
)
def view_rows(spark, d):
    names = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("doc_id") % 70), lambda i: i.cast("string"))
    records = _portal_docs(spark, d).select(
        F.col("key").alias("id"), F.concat(F.lit("View "), "key").alias("name"), F.col("text").alias("description"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("category"), F.lit("https://example.org").alias("resource_url"),
        F.when(F.col("doc_id") % 70 == 0, F.array().cast("array<string>")).otherwise(names).alias("column_names"),
        (F.col("doc_id") % 5).alias("row_count"),
    )
    return catalog_sync.view_rows(records).select("id", "organization", F.size("columns").cast("bigint").alias("n_columns"), "attribution_text")


@query(
    "package_rows",
    """SELECT 'ckan:' || doc_id || ':r' || doc_id AS id, 'Package ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' (csv)' ELSE ' (JSON)' END AS title, CASE WHEN doc_id % 2 = 0 THEN 'CSV' ELSE 'JSON' END AS format,
              CASE WHEN doc_id % 3 = 0 THEN 'CC0' ELSE 'US_PD' END AS license_normalized FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 3 <> 2""",
)
def package_rows(spark, d):
    k = F.col("doc_id") % 3
    extras = F.when(k == 1, F.array(F.struct(F.lit("license_id").alias("key"), F.lit("us-pd").alias("value"))))
    packages = _portal_docs(spark, d).select(
        F.col("key").alias("pkg_id"), F.col("key").alias("name"), F.concat(F.lit("Package "), "key").alias("title"), F.col("text").alias("notes"),
        F.col("source").alias("organization"), F.array("lang").alias("tags"), F.when(k == 0, "cc-zero").alias("license_title"),
        F.when(k == 2, "cc-by").alias("license_id"), F.lit(None).cast("string").alias("license"), extras.alias("extras"),
        F.struct(
            F.concat(F.lit("r"), "key").alias("id"),
            F.when(F.col("doc_id") % 7 == 0, "pdf").when(F.col("doc_id") % 2 == 0, "csv").otherwise("JSON").alias("format"),
            F.lit("https://example.org/f").alias("url"),
        ).alias("resource"),
    )
    return catalog_sync.package_rows(packages).select("id", "title", "format", "license_normalized")


# --- set operations -----------------------------------------------------------------------------


@query(
    "union_by_name",
    "SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier",
)
def union_by_name(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("union_distinct", "SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("id")).union(t(spark, d, "supplier").select("s_nationkey")).distinct()


@query("intersect_ids", "SELECT o_custkey AS id FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def intersect_ids(spark, d):
    return t(spark, d, "orders").select(F.col("o_custkey").alias("id")).intersect(t(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("ids_not_seen", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def ids_not_seen(spark, d):
    used = t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return joins.without_used(t(spark, d, "part").select(F.col("p_partkey").alias("id")), used)
