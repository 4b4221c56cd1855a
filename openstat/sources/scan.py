"""CSV and JSON scans and the two provider-specific flattenings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sample_ratio: float | None = None) -> DataFrame:
    """Header row and inferred types. Give a schema, or a sampling ratio, for very large files."""
    reader = spark.read.option("header", True).option("multiLine", False).option("escape", '"')
    if schema:
        return reader.schema(schema).csv(path)
    if sample_ratio:
        reader = reader.option("samplingRatio", sample_ratio)
    return reader.option("inferSchema", True).option("preferDate", True).csv(path)


def read_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Records of a JSON file. Keys are the union over all rows.

    A list of objects gives a row each, a single object gives one row, and a
    `[meta, rows]` envelope gives the rows of its second element; a folder may hold
    files of all three shapes. Where no file has a row the table is empty with one
    placeholder column. `lines` reads one object per line, which splits across
    tasks; a single document cannot be split.
    """
    if lines:
        return spark.read.json(path)
    inner = F.get_json_object("value", "$[1]")
    kind = (
        F.when(F.ltrim("value").startswith("{"), "object")
        .when((F.json_array_length("value") >= 2) & inner.startswith("["), "envelope")
        .when(F.json_array_length("value") >= 0, "list").otherwise("other")
    )
    rows = (
        F.when(F.col("kind") == "object", F.concat(F.lit("["), "value", F.lit("]")))
        .when(F.col("kind") == "envelope", inner).when(F.col("kind") == "list", F.col("value"))
    )
    text = spark.read.text(path, wholetext=True).withColumn("kind", kind).select("kind", rows.alias("rows"))
    text = text.withColumn("filled", F.json_array_length("rows") > 0)
    kinds = {r["kind"]: r["filled"] for r in text.groupBy("kind").agg(F.bool_or("filled").alias("filled")).collect()}
    if "other" in kinds:
        raise ValueError("Unsupported JSON shape")
    if not any(kinds.values()):
        return spark.createDataFrame([], T.StructType([T.StructField("placeholder", T.StringType())]))
    if "envelope" in kinds or len(kinds) > 1:
        return from_json_records(text.where("filled").select("rows"), "rows")
    return spark.read.option("multiLine", True).json(path)


def _merged_schema(df: DataFrame, column: str) -> str:
    """Schema of all JSON texts in a column, merged as an aggregate; mixed types read as text."""
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(column))).first()[0]
    found = re.sub(r"DECIMAL\(\d+, ?\d+\)", "DOUBLE", found)
    return re.sub(r"\b(VARIANT|VOID)\b", "STRING", found).replace("OBJECT<", "STRUCT<")


def from_json_records(df: DataFrame, column: str) -> DataFrame:
    """Rows of a column that holds JSON arrays of objects; keys are the union over all rows."""
    parsed = df.select(F.from_json(F.col(column), _merged_schema(df, column)).alias("rows"))
    return parsed.select(F.explode("rows").alias("r")).select("r.*")


def from_json_objects(df: DataFrame, column: str) -> DataFrame:
    """One JSON object per row as columns, keys unioned over all rows."""
    return df.withColumn("__r", F.from_json(F.col(column), _merged_schema(df, column))).select(
        *[c for c in df.columns if c != column], "__r.*"
    )


def _text(record: Column, path: str) -> Column:
    return F.nullif(F.get_json_object(record, path), F.lit(""))


def flatten_indicator(df: DataFrame, column: str) -> DataFrame:
    """Nested indicator records (one JSON object per row) as six flat columns."""
    r = F.col(column)
    value = F.get_json_object(r, "$.value")
    inner = F.when(value.startswith("{"), F.get_json_object(value, "$.value")).otherwise(value)
    return df.select(
        F.coalesce(_text(r, "$.countryiso3code"), _text(r, "$.country.id")).alias("countryiso3code"),
        F.coalesce(_text(r, "$.country.value"), _text(r, "$.country.id")).alias("country"),
        F.get_json_object(r, "$.indicator.id").alias("indicator_id"),
        F.coalesce(_text(r, "$.indicator.value"), _text(r, "$.indicator.id")).alias("indicator"),
        F.get_json_object(r, "$.date").alias("date"),
        inner.try_cast("double").alias("value"),
    )


def series_id(resource_id: Column, url: Column) -> Column:
    """Series id from a `fred:` resource id, otherwise from the URL parameter."""
    from_url = F.try_parse_url(url, F.lit("QUERY"), F.lit("series_id"))
    return F.when(resource_id.startswith("fred:"), F.substring_index(resource_id, "fred:", -1)).otherwise(
        F.coalesce(F.nullif(from_url, F.lit("")), F.lit("unknown"))
    )


def flatten_observations(df: DataFrame, column: str, resource_id: Column, url: Column) -> DataFrame:
    """(date, value, series_id) of `{observations: [{date, value}]}` payloads, bad values dropped."""
    shape = "struct<observations:array<struct<date:string,value:string>>>"
    rows = df.select(
        series_id(resource_id, url).alias("series_id"),
        F.explode(F.from_json(F.col(column), shape)["observations"]).alias("o"),
    )
    raw = F.trim(F.col("o.value"))
    number = F.when(~raw.isin(".", ""), raw.try_cast("double"))
    return rows.select(F.col("o.date").alias("date"), number.alias("value"), "series_id").where("value is not null")

