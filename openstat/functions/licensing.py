"""License and attribution rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from openstat import rules
from openstat.functions.text import literal_map


def normalize_license(raw: Column) -> Column:
    """Exact names first, then markers in order; null when nothing is recognized."""
    key = F.lower(F.trim(raw))
    out = F.element_at(literal_map(rules.LICENSE_EXACT), key)
    for marker, code in rules.LICENSE_MARKERS:
        out = F.coalesce(out, F.when(key.contains(marker), code))
    return F.when(key != "", out)


def license_allowed(code: Column, portal: Column) -> Column:
    open_license = code.isin(*rules.LICENSE_OPEN)
    with_credit = (portal == "world_bank") & (code == "CC_BY")
    return F.coalesce(open_license | with_credit, F.lit(False))


def attribution_required(code: Column) -> Column:
    return F.coalesce(code == "CC_BY", F.lit(False))


def attribution_text(portal: Column, title: Column, publisher: Column, url: Column) -> Column:
    return (
        F.when(
            portal == "world_bank",
            F.format_string(
                "The World Bank: %s: %s. Source: %s. Licensed under CC BY 4.0.", title, publisher, url
            ),
        )
        .when(
            portal == "fred",
            F.format_string(
                "Source: %s. Retrieved from FRED, Federal Reserve Bank of St. Louis; %s.", title, url
            ),
        )
        .when(portal == "nyc_open_data", F.format_string("Source: NYC Open Data — %s. %s", title, url))
        .otherwise(F.format_string("Source: %s. %s", publisher, url))
    )


def license_of_record(license_field: Column, description: Column) -> Column:
    """The stated license, otherwise one implied by markers in the description."""
    low = F.lower(F.coalesce(description, F.lit("")))
    return F.coalesce(
        F.nullif(F.trim(license_field), F.lit("")),
        F.when(
            low.contains("cc0") | low.contains("creative commons zero"),
            "https://creativecommons.org/publicdomain/zero/1.0/",
        ),
        F.when(
            low.contains("public domain") & F.regexp_replace(low, " ", "").contains("17usc"),
            "https://www.usa.gov/publicdomain/label/1.0/",
        ),
    )


def license_of_package(title: Column, code: Column, name: Column, extras: Column) -> Column:
    """First non-empty license key of a package, otherwise its first license extra."""
    def filled(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    from_extras = F.filter(
        extras, lambda e: e["key"].isin("license", "license_id", "license_title")
    )
    return F.coalesce(
        filled(title), filled(code), filled(name),
        F.when(F.size(from_extras) > 0, F.coalesce(F.get(from_extras, F.lit(0))["value"], F.lit(""))),
    )
