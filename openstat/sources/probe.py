"""Is a payload a usable table? Format verdicts and download-link ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from openstat import rules
from openstat.functions.text import is_generic_header

_VERDICT = "struct<ingestible:boolean,reason:string,detected_format:string,columns:array<string>,row_count:bigint>"


def _verdict(ok: bool | Column, reason, fmt, columns: Column | None = None, rows: Column | None = None) -> Column:
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        col(ok).alias("ingestible"), col(reason).alias("reason"), col(fmt).alias("detected_format"),
        (F.lit(None).cast("array<string>") if columns is None else columns).alias("columns"),
        (F.lit(None) if rows is None else rows).cast("bigint").alias("row_count"),
    )


def _header_problem(columns: Column, generic: Column) -> Column:
    """Reason text when too few column names mean anything (`generic` of them do not), else null."""
    meaningful = F.size(columns) - generic
    return (
        F.when(
            meaningful < 2,
            F.format_string(
                "only %d meaningful column name(s) — headers look generic "
                "(e.g. column1, column08); need at least 2 descriptive fields", meaningful
            ),
        )
        .when(
            generic / F.size(columns) >= 0.5,
            F.format_string("%d of %d columns have generic names — dataset likely lacks a proper header row", generic, F.size(columns)),
        )
    )


def _too_few(rows: Column, what: str, minimum: int = rules.MIN_TABLE_ROWS) -> Column:
    return F.when(rows < minimum, F.format_string(f"{what} has %d row(s) — need at least {minimum}", rows))


def _with_json(df: DataFrame, text: Column) -> DataFrame:
    """Adds what the JSON verdict reads of `text` (null: nothing to read).

    Each step is a column of its own, so a payload is parsed once for each and not again for
    each place that the verdict names it.
    """
    c, trimmed = F.col, F.ltrim(text)
    df = df.withColumns({"__object": trimmed.startswith("{"), "__list": trimmed.startswith("[")})
    df = df.withColumns({
        "__valid": F.try_parse_json(text).isNotNull(),
        "__type": F.when(c("__object"), F.get_json_object(text, "$.type")),
        "__length": F.when(c("__list"), F.json_array_length(text)),
        "__second": F.when(c("__list"), F.get_json_object(text, "$[1]")),
    })
    df = df.withColumn(
        "__envelope", c("__list") & (c("__length") >= 2) & F.coalesce(F.ltrim("__second").startswith("["), F.lit(False))
    )
    df = df.withColumns({
        "__rows": F.when(c("__envelope"), F.json_array_length("__second")).when(c("__list"), c("__length")).otherwise(1),
        "__first": F.when(c("__envelope"), F.get_json_object("__second", "$[0]"))
        .when(c("__list"), F.get_json_object(text, "$[0]")).otherwise(text),
    })
    df = df.withColumn("__flat", F.coalesce(F.ltrim("__first").startswith("{"), F.lit(False)))
    df = df.withColumns({
        "__keys": F.json_object_keys(F.when(c("__flat"), c("__first"))),
        "__cells": F.map_values(F.from_json(F.when(c("__flat"), c("__first")), "map<string,string>")),
    })
    return df.withColumns({
        "__nested": F.exists("__cells", lambda v: F.coalesce(v.rlike(r"^\s*[\[{]"), F.lit(False))),
        "__few": _too_few(c("__rows"), "JSON dataset"),
        "__generic": F.size(F.filter("__keys", is_generic_header)),
    }).withColumn("__names", _header_problem(c("__keys"), c("__generic")))


def _json_verdict() -> Column:
    """The verdict on the columns of `_with_json`."""
    c = F.col
    rows, keys, nested, few, names = c("__rows"), c("__keys"), c("__nested"), c("__few"), c("__names")
    fmt = F.when(c("__envelope"), "JSON_WORLDBANK").otherwise("JSON_RECORDS")
    panel = c("__envelope") | F.array_contains(keys, "indicator") | F.array_contains(keys, "country")
    return (
        F.when(~c("__valid"), _verdict(False, "invalid JSON", "JSON_INVALID"))
        .when(c("__object") & (c("__type") == "FeatureCollection"), _verdict(False, "GeoJSON not supported yet", "GEOJSON"))
        .when(~c("__object") & ~c("__list"), _verdict(False, "unsupported JSON shape", "JSON_NESTED"))
        .when(rows == 0, _verdict(False, "JSON has no rows", "EMPTY"))
        .when(~c("__flat"), _verdict(False, "JSON rows are not objects", "JSON_NESTED"))
        .when(nested & panel & few.isNotNull(), _verdict(False, few, None, None, rows))
        .when(nested & panel, _verdict(True, "nested JSON — flattened on ingest", "JSON_WORLDBANK", keys, rows))
        .when(nested, _verdict(False, "nested JSON objects need a source adapter", "JSON_NESTED"))
        .when(F.size(keys) < 2, _verdict(False, "need at least 2 columns for analysis", "JSON_NESTED"))
        .when(few.isNotNull(), _verdict(False, few, None, None, rows))
        .when(names.isNotNull(), _verdict(False, names, fmt, keys, rows))
        .otherwise(_verdict(True, "flat JSON records", fmt, keys, rows))
    )


def _with_csv(df: DataFrame, text: Column) -> DataFrame:
    """Adds what the CSV verdict reads of `text`, a step per column as in `_with_json`."""
    df = df.withColumn("__lines", F.split(F.regexp_replace(text, r"(\r\n|\n|\r)+$", ""), r"\r\n|\n|\r"))
    df = df.withColumns({
        "__header": F.transform(
            F.regexp_extract_all(F.concat(F.element_at("__lines", 1), F.lit(",")), F.lit(r'("(?:[^"]|"")*"|[^,]*),'), F.lit(1)),
            lambda c: F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"'),
        ),
        "__lines": F.size("__lines") - 1,
    })
    return df.withColumns({
        "__few_lines": _too_few(F.col("__lines"), "CSV sample"),
        "__generic_header": F.size(F.filter("__header", is_generic_header)),
    }).withColumn("__header_names", _header_problem(F.col("__header"), F.col("__generic_header")))


def _csv_verdict(text: Column, head_bytes: int) -> Column:
    """The verdict on the columns of `_with_csv`."""
    header, rows, few, names = (F.col(c) for c in ("__header", "__lines", "__few_lines", "__header_names"))
    full_head = F.octet_length(text) >= head_bytes - 1024
    return (
        F.when(F.trim(text) == "", _verdict(False, "empty CSV", "EMPTY"))
        .when(F.size(header) < 2, _verdict(False, "CSV needs a header with 2+ columns", "CSV"))
        .when(rows == 0, _verdict(False, "CSV has no data rows", "EMPTY"))
        .when(few.isNotNull() & full_head, _verdict(True, F.format_string("CSV tabular file (≥%d rows in sample)", rows), "CSV", header, rows))
        .when(few.isNotNull(), _verdict(False, few, None, None, rows))
        .when(names.isNotNull(), _verdict(False, names, "CSV", header, rows))
        .otherwise(_verdict(True, "CSV tabular file", "CSV", header, rows))
    )


def probe_payloads(df: DataFrame, payload: str, url: str, head_bytes: int = 256_000) -> DataFrame:
    """Verdict columns per payload: ingestible, reason, detected_format, columns, row_count.

    The format is told from the first characters and the URL; the verdict then
    reads the whole payload that was fetched. JSON wins over CSV when both fit.
    """
    text, link = F.coalesce(F.col(payload), F.lit("")), F.lower(F.coalesce(F.col(url), F.lit("")))
    head = F.lower(F.ltrim(F.left(text, F.lit(512))))
    start = F.ltrim(F.left(text, F.lit(200)))
    html = head.startswith("<!doctype") | head.startswith("<html") | F.left(head, F.lit(200)).contains("<head")
    json_like = link.contains("json") | start.startswith("{") | start.startswith("[")
    csv_like = link.contains("csv") | (start.contains(",") & start.contains("\n"))
    kind = (
        F.when(text == "", "EMPTY").when(html, "HTML").when(text.startswith("PK"), "ZIP")
        .when(json_like, "json").when(csv_like, "csv").otherwise("UNKNOWN")
    )
    k = F.col("__kind")
    verdict = (
        F.when(k == "EMPTY", _verdict(False, "empty file", "EMPTY"))
        .when(k == "HTML", _verdict(False, "HTML page, not a data file", "HTML"))
        .when(k == "ZIP", _verdict(False, "ZIP archive — unpack not supported yet", "ZIP"))
        .when(k == "json", _json_verdict())
        .when(k == "csv", _csv_verdict(F.col("__csv"), head_bytes))
        .otherwise(_verdict(False, "unsupported or unrecognized format", "UNKNOWN"))
    )
    read = df.withColumn("__kind", kind).withColumns({"__json": F.when(k == "json", text), "__csv": F.when(k == "csv", text)})
    # small compressed files come in few partitions, and parsing is the work: deal the rows out
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    read = _with_csv(_with_json(read.repartition(tasks), F.col("__json")), F.col("__csv"))
    return read.withColumn("__v", verdict.cast(_VERDICT)).select(*df.columns, "__v.*")


def probe_indicator_envelope(df: DataFrame, payload: str) -> DataFrame:
    """Verdict for `[meta, rows]` indicator payloads: at least twenty observations."""
    text = F.col(payload)
    second = F.get_json_object(text, "$[1]")
    total = F.coalesce(F.get_json_object(text, "$[0].total").try_cast("bigint"), F.json_array_length(second).cast("bigint"), F.lit(0))
    total = F.when(total == 0, F.coalesce(F.json_array_length(second), F.lit(0))).otherwise(total)
    few = _too_few(total, "World Bank indicator")
    columns = F.array(*[F.lit(c) for c in ("countryiso3code", "country", "indicator_id", "indicator", "date", "value")])
    verdict = (
        F.when(F.try_parse_json(text).isNull(), _verdict(False, "invalid World Bank JSON", "JSON_INVALID"))
        .when(F.coalesce(F.json_array_length(text), F.lit(0)) < 2, _verdict(False, "unsupported World Bank JSON shape", "JSON_NESTED"))
        .when(few.isNotNull(), _verdict(False, few, None, None, total))
        .otherwise(_verdict(True, F.format_string("World Bank API (%d observations)", total), "JSON_WORLDBANK", columns, total))
    )
    return df.withColumn("__v", verdict.cast(_VERDICT)).select(*df.columns, "__v.*")


def probe_series(df: DataFrame, payload: str) -> DataFrame:
    """Verdict for series payloads: an API error, or at least twenty points."""
    text = F.col(payload)
    total = F.coalesce(F.get_json_object(text, "$.count").try_cast("bigint"), F.lit(0))
    failed = F.coalesce(F.get_json_object(text, "$.error_code"), F.lit("")).isin("", "0", "false") == F.lit(False)
    few = _too_few(total, "FRED series")
    columns = F.array(F.lit("date"), F.lit("value"), F.lit("series_id"))
    message = F.coalesce(F.nullif(F.get_json_object(text, "$.error_message"), F.lit("")), F.lit("FRED API error"))
    verdict = (
        F.when(F.try_parse_json(text).isNull(), _verdict(False, "invalid FRED JSON", "JSON_INVALID"))
        .when(~F.ltrim(text).startswith("{"), _verdict(False, "unsupported FRED JSON shape", "JSON_NESTED"))
        .when(failed, _verdict(False, message, "HTTP_ERROR"))
        .when(few.isNotNull(), _verdict(False, few, None, None, total))
        .otherwise(_verdict(True, F.format_string("FRED observations (%d points)", total), "JSON_FRED", columns, total))
    )
    return df.withColumn("__v", verdict.cast(_VERDICT)).select(*df.columns, "__v.*")


# --- download links ------------------------------------------------------------------


def format_hint(declared: Column, url: Column) -> Column:
    """CSV or JSON by declared format or suffix, else the last part of the declared type."""
    fmt, low = F.upper(F.coalesce(declared, F.lit(""))), F.lower(url)
    return (
        F.when(fmt.contains("CSV") | low.endswith(".csv"), "CSV")
        .when(fmt.contains("JSON") | low.endswith(".json"), "JSON")
        .when(fmt != "", F.left(F.element_at(F.split(fmt, "/"), -1), F.lit(32)))
        .otherwise("UNKNOWN")
    )


def link_score(download: Column, url: Column, declared: Column) -> Column:
    """Higher means more likely a direct tabular download."""
    low, fmt = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(declared, F.lit("")))
    blocked = reduce(lambda a, b: a | b, [low.contains(e) for e in rules.BLOCKED_EXTENSIONS])
    has_file = reduce(lambda a, b: a | b, [low.endswith(e) for e in (".csv", ".json", ".tsv", ".txt")])
    slashes = F.length(low) - F.length(F.replace(low, F.lit("/"), F.lit("")))
    shallow = ~has_file & (slashes <= 4) & ~low.contains("download") & ~low.contains("api/")

    def points(condition: Column, value: int) -> Column:
        return F.when(condition, value).otherwise(0)

    score = (
        points(F.coalesce(download, F.lit("")) != "", 25)
        + points(low.endswith(".csv") | low.endswith(".csv?"), 50)
        + points(low.endswith(".json") | low.endswith(".json?"), 45)
        + points(fmt.contains("csv") | low.contains("/csv"), 40)
        + points(fmt.contains("json"), 35)
        + points(low.endswith(".tsv") | fmt.contains("tab-separated"), 30)
        - points(blocked, 60) - points(shallow, 35)
    )
    return F.when(low == "", -100).otherwise(score)


def rank_links(links: DataFrame, keep: int | None = 1) -> DataFrame:
    """Best links per dataset. Columns: id, position, download_url, access_url, format, media_type."""
    def filled(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(""))

    url, declared = F.coalesce(filled("download_url"), filled("access_url")), F.coalesce(filled("format"), filled("media_type"))
    scored = links.withColumns(
        {"url": url, "format_hint": format_hint(declared, url), "score": link_score(F.col("download_url"), url, declared)}
    ).where("url is not null")
    order = W.partitionBy("id").orderBy(F.desc("score"), "position")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= keep) if keep else ranked
