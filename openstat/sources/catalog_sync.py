"""Catalog upkeep: portal records to catalog rows, upsert, prune and probe results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from openstat import rules
from openstat.functions import licensing as lic
from openstat.functions.text import contains_any, literal_map, search_text


def upsert(current: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Insert or replace by key: the incoming row wins.

    The newest version per key is an aggregate, so copies of one key are combined
    before the shuffle instead of being sorted in one task.
    """
    both = current.withColumn("__v", F.lit(0)).unionByName(incoming.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c not in (key, "__v")]
    latest = both.groupBy(key).agg(F.max_by(F.struct(*columns), "__v").alias("r"))
    return latest.select(key, "r.*")


def prune_stale(catalog: DataFrame, seen: DataFrame, portal: str, id_prefix: str | None = None, *,
                exhausted: bool = True, hit_cap: bool = False, partial: bool = False) -> DataFrame:
    """Drop a portal's rows that a completed pass did not see; nothing when it saw none.

    A pass that stopped early, met its cap or covered only a part drops nothing.
    """
    if not exhausted or hit_cap or partial:
        return catalog
    candidate = (F.col("portal") == portal) & (F.col("id").startswith(id_prefix) if id_prefix else F.lit(True))
    ids = seen.select("id").distinct().withColumn("__seen", F.lit(True))
    saw_any = seen.limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    joined = catalog.join(ids, "id", "left")
    return joined.where(~(candidate & F.col("__seen").isNull() & saw_any)).drop("__seen").select(*catalog.columns)


def apply_probe(catalog: DataFrame, probes: DataFrame, at: Column | None = None) -> DataFrame:
    """Write probe verdicts onto rows; row hint and columns change only when the probe knows them."""
    p = probes.select(
        "id", F.struct("ingestible", "reason", "detected_format", "columns", "row_count").alias("__p")
    )
    joined = catalog.join(p, "id", "left")
    probed, v = F.col("__p").isNotNull(), F.col("__p")
    named = F.transform(F.slice(v["columns"], 1, 50), lambda c: F.struct(c.alias("name")))
    return joined.withColumns(
        {
            "ingestible": F.when(probed, v["ingestible"]).otherwise(F.col("ingestible")),
            "ingest_block_reason": F.when(probed, F.when(~v["ingestible"], v["reason"])).otherwise(F.col("ingest_block_reason")),
            "detected_format": F.when(probed, v["detected_format"]).otherwise(F.col("detected_format")),
            "row_count_hint": F.coalesce(v["row_count"], F.col("row_count_hint")),
            "columns": F.when(F.size(v["columns"]) > 0, named).otherwise(F.col("columns")),
            "probed_at": F.when(probed, F.current_timestamp() if at is None else at).otherwise(F.col("probed_at")),
        }
    ).drop("__p").select(*catalog.columns)


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _row(df: DataFrame, portal: str, **cols: Column) -> DataFrame:
    """Catalog row with the shared license, attribution and search rules applied."""
    p = F.lit(portal)
    base = df.select(
        cols["id"].alias("id"), p.alias("portal"), cols["title"].alias("title"),
        _filled(cols["description"]).alias("description"), cols["organization"].alias("organization"),
        cols["tags"].alias("tags"), cols["format"].alias("format"), cols["license"].alias("license_normalized"),
        cols["license_raw"].alias("license_raw"), cols["license_display"].alias("license_display"),
        cols["publisher"].alias("publisher"), cols["source_url"].alias("source_url"),
        cols["resource_url"].alias("resource_url"), cols["columns"].alias("columns"),
        cols.get("search_extra", F.array().cast("array<string>")).alias("__extra"),
        cols.get("search_title", cols["title"]).alias("__title"),
    )
    return base.withColumns(
        {
            "attribution_required": lic.attribution_required(F.col("license_normalized")),
            "attribution_text": lic.attribution_text(p, F.col("__title"), F.col("organization"), F.col("source_url")),
            "search_text": search_text(
                F.col("__title"), F.col("description"), F.col("organization"), F.concat("tags", "__extra")
            ),
        }
    ).drop("__extra", "__title")


def _names(*names: str) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name")) for n in names])


_NO_COLUMNS = "array<struct<name:string>>"


def indicator_rows(records: DataFrame) -> DataFrame:
    """Indicator records: id, name, source_organization, source_name, source_note, topics (array of text)."""
    org = F.left(F.coalesce(_filled(F.col("source_organization")), _filled(F.col("source_name")), F.lit("World Bank")), F.lit(512))
    title = F.coalesce(_filled(F.col("name")), F.col("id"))
    return _row(
        records.where("id is not null and id <> ''"), "world_bank",
        id=F.concat(F.lit("wb:"), "id"), title=F.left(F.trim(title), F.lit(512)), search_title=title,
        description=F.left(F.coalesce("source_note", F.lit("")), F.lit(2000)), organization=org,
        tags=F.filter("topics", lambda x: x.isNotNull() & (x != "")), format=F.lit("JSON_WORLDBANK"),
        license=F.lit("CC_BY"), license_raw=F.lit("CC-BY-4.0 (World Bank Terms of Use)"),
        license_display=F.lit("CC BY 4.0 — attribution required"), publisher=F.lit("World Bank"),
        source_url=F.concat(F.lit("https://data.worldbank.org/indicator/"), "id"),
        resource_url=F.format_string("https://api.worldbank.org/v2/country/all/indicator/%s?format=json&per_page=500", "id"),
        columns=_names("countryiso3code", "country", "indicator_id", "indicator", "date", "value"),
    )


def dcat_rows(records: DataFrame) -> DataFrame:
    """DCAT records: slug, title, description, license, access_level, organization, publisher, keywords, landing_page.

    Only public records with an open license stay.
    """
    desc = F.left(F.coalesce("description", F.lit("")), F.lit(4000))
    raw = lic.license_of_record(F.col("license"), desc)
    code = F.when(contains_any(F.lower(raw), rules.CC0_MARKERS), "CC0").otherwise(lic.normalize_license(raw))
    public = F.lower(F.coalesce("access_level", F.lit(""))).isin("", "public")
    rows = records.withColumns({"__raw": raw, "__code": code}).where(
        public & F.coalesce(F.col("slug") != "", F.lit(False)) & lic.license_allowed(F.col("__code"), F.lit("data_gov"))
    )
    display = F.coalesce(F.element_at(literal_map(rules.LICENSE_DISPLAY), F.col("__code")), F.col("__raw"))
    org = F.coalesce(_filled(F.col("organization")), _filled(F.col("publisher")), F.lit("data.gov"))
    page = F.coalesce(_filled(F.col("landing_page")), F.concat(F.lit("https://catalog.data.gov/dataset/"), "slug"))
    return _row(
        rows, "data_gov", id=F.concat(F.lit("datagov:"), "slug"),
        title=F.coalesce(_filled(F.col("title")), F.lit("Dataset")), description=desc, organization=org,
        tags=F.coalesce("keywords", F.array().cast("array<string>")), format=F.lit("UNKNOWN"),
        license=F.col("__code"), license_raw=F.coalesce("__raw", display), license_display=display,
        publisher=org, source_url=page, resource_url=page, columns=F.lit(None).cast(_NO_COLUMNS),
    )


def series_rows(records: DataFrame) -> DataFrame:
    """Series records: id, title, notes, frequency, units, resource_url. Copyrighted notes drop out."""
    notes = F.left(F.coalesce("notes", F.lit("")), F.lit(2000))
    org = F.lit("Federal Reserve Bank of St. Louis (FRED)")
    copyrighted = F.lower(notes).contains("copyright")
    return _row(
        records.where(~copyrighted), "fred", id=F.concat(F.lit("fred:"), "id"),
        title=F.coalesce(_filled(F.col("title")), F.col("id")), description=notes, organization=org,
        tags=F.filter(F.array(F.col("frequency"), F.col("units")), lambda x: x.isNotNull() & (x != "")),
        search_extra=F.array("id"), format=F.lit("JSON_FRED"), license=F.lit("US_GOV_WORK"),
        license_raw=F.lit("US Government Work / public domain (citation requested)"),
        license_display=F.lit("US Government Work — citation requested"), publisher=org,
        source_url=F.concat(F.lit("https://fred.stlouisfed.org/series/"), "id"), resource_url=F.col("resource_url"),
        columns=_names("date", "value", "series_id"),
    )


def view_rows(records: DataFrame) -> DataFrame:
    """Portal view records: id, name, description, category, resource_url, column_names, row_count. Empty ones drop out."""
    rows = records.where(F.coalesce("row_count", F.lit(-1)) != 0)
    org = F.left(F.coalesce(_filled(F.col("category")), F.lit("NYC Open Data")), F.lit(512))
    return _row(
        rows, "nyc_open_data", id=F.concat(F.lit("nyc:"), "id"),
        title=F.left(F.coalesce(_filled(F.col("name")), F.col("id")), F.lit(512)),
        description=F.left(F.coalesce("description", F.lit("")), F.lit(4000)), organization=org,
        tags=F.filter(F.array("category"), lambda x: x.isNotNull() & (x != "")),
        search_extra=F.array(F.col("id"), F.lit("nyc"), F.lit("new york")), format=F.lit("JSON_SOCRATA"),
        license=F.lit("US_GOV_WORK"), license_raw=F.lit("NYC Open Data Terms of Use"),
        license_display=F.lit("NYC Open Data — US Government Work"), publisher=org,
        source_url=F.concat(F.lit("https://data.cityofnewyork.us/d/"), "id"), resource_url=F.col("resource_url"),
        columns=F.transform(F.slice("column_names", 1, 50), lambda c: F.struct(c.alias("name"))),
    )


def package_rows(packages: DataFrame) -> DataFrame:
    """Package resources: pkg_id, name, title, notes, organization, tags, license_title, license_id, license, extras, resource (id, format, url)."""
    raw = lic.license_of_package(F.col("license_title"), F.col("license_id"), F.col("license"), F.col("extras"))
    fmt = F.upper(F.coalesce(F.col("resource.format"), F.lit("")))
    rows = packages.withColumns({"__raw": raw, "__code": lic.normalize_license(raw)}).where(
        lic.license_allowed(F.col("__code"), F.lit("data_gov"))
        & fmt.isin("CSV", "JSON", "TEXT/CSV", "APPLICATION/JSON") & F.coalesce(F.col("resource.url") != "", F.lit(False))
    )
    title = F.coalesce(_filled(F.col("title")), F.col("pkg_id"))
    org = F.coalesce(_filled(F.col("organization")), F.lit("data.gov"))
    display = F.coalesce(F.element_at(literal_map(rules.LICENSE_DISPLAY), F.col("__code")), F.col("__raw"), F.lit("Open"))
    return _row(
        rows, "data_gov",
        id=F.concat(F.lit("ckan:"), "pkg_id", F.lit(":"), F.coalesce("resource.id", "resource.url")),
        title=F.format_string("%s (%s)", title, F.col("resource.format")), search_title=title,
        description=F.left(F.coalesce("notes", F.lit("")), F.lit(4000)), organization=org,
        tags=F.filter("tags", lambda x: x.isNotNull() & (x != "")), format=F.left(fmt, F.lit(32)),
        license=F.col("__code"), license_raw=F.col("__raw"), license_display=display, publisher=org,
        source_url=F.concat(F.lit("https://catalog.data.gov/dataset/"), F.coalesce(_filled(F.col("name")), F.col("pkg_id"))),
        resource_url=F.col("resource.url"), columns=F.lit(None).cast(_NO_COLUMNS),
    )
