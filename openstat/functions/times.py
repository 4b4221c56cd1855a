"""Time rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "America/New_York"

#: fixed values: layouts besides ISO, as pattern and the ISO form it is rewritten to
_NUMERIC_LAYOUTS = (
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})(.*)$", "$3-$1-$2$4"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})(.*)$", "$1-$2-$3$4"),
)
_DAY_MONTH = r"^(\d{1,2})[ -]([A-Za-z]{3})[a-z]*[ -](\d{4})$"
_MONTH_DAY = r"^([A-Za-z]{3})[a-z]* (\d{1,2}), (\d{4})$"
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def parse_time(text: Column) -> Column:
    """ISO text, or a common layout rewritten to ISO first; null otherwise. Session zone is UTC."""
    t = F.trim(text)
    months = F.array(*[F.lit(m) for m in _MONTHS])

    def month(pattern: str, group: int) -> Column:
        return F.array_position(months, F.lower(F.regexp_extract(t, pattern, group))).cast("string")

    iso = F.when(t.rlike(r"^\d{4}-"), t)
    for pattern, rewritten in _NUMERIC_LAYOUTS:
        iso = iso.when(t.rlike(pattern), F.regexp_replace(t, pattern, rewritten))
    iso = iso.when(
        t.rlike(_DAY_MONTH),
        F.concat_ws("-", F.regexp_extract(t, _DAY_MONTH, 3), month(_DAY_MONTH, 2), F.regexp_extract(t, _DAY_MONTH, 1)),
    ).when(
        t.rlike(_MONTH_DAY),
        F.concat_ws("-", F.regexp_extract(t, _MONTH_DAY, 3), month(_MONTH_DAY, 1), F.regexp_extract(t, _MONTH_DAY, 2)),
    )
    return iso.try_cast("timestamp")


def epoch_time(number: Column) -> Column:
    """Epoch seconds, or milliseconds when larger than 1e12; null when not positive."""
    n = number.try_cast("double")
    seconds = F.when(n > 1e12, n / 1000.0).otherwise(n)
    return F.when(n > 0, F.timestamp_micros((seconds * 1_000_000).try_cast("bigint")))


def iso_time(text: Column) -> Column:
    """ISO text with Z, +0000 or an offset, read as UTC."""
    fixed = F.regexp_replace(text, r"\+0000$", "+00:00")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), fixed.try_cast("timestamp"))


def first_time(*candidates: Column) -> Column:
    """First time that parsed, otherwise the earliest representable one."""
    return F.coalesce(*candidates, F.lit("0001-01-01 00:00:00").cast("timestamp"))


def year_of(value: Column, dtype: str) -> Column:
    """Year of a timestamp, a year number, a date text, or any parseable text."""
    if dtype.startswith(("timestamp", "date")):
        return F.year(value)
    text = F.trim(value.cast("string"))
    return (
        F.when(text.rlike(r"^\d{4}$"), text.try_cast("int"))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.left(text, F.lit(4)).try_cast("int"))
        .otherwise(F.year(parse_time(text)))
    )


def local_day(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """Calendar day of a UTC time in a local zone."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def local_bounds(day: str, last_day: str | None = None, zone: str = LOCAL_ZONE) -> tuple[Column, Column]:
    """UTC first and last second of a local day, or of a run of local days."""
    start = F.to_utc_timestamp(F.lit(f"{day} 00:00:00").cast("timestamp"), zone)
    end = F.to_utc_timestamp(F.lit(f"{last_day or day} 23:59:59").cast("timestamp"), zone)
    return start, end


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6
