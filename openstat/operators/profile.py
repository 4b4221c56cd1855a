"""Column profiles, facts, validation and measure labels.

All per-column counts come from one aggregate, distinct counts from one job with a
branch per column, value lists and top values from one grouped (column, value)
table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from openstat import rules
from openstat.operators.coerce import is_nested, is_numeric, is_time


def _ref(name: str) -> Column:
    return F.col(f"`{name}`")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(name, value, n) for every non-null value of every column, combined map-side."""
    names = columns or df.columns
    cells = F.array(
        *[F.struct(F.lit(c).alias("name"), _ref(c).cast("string").alias("value")) for c in names]
    )
    return (
        df.select(F.inline(cells)).where(F.col("value").isNotNull()).groupBy("name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def distinct_counts(df: DataFrame, columns: list[str] | None = None, relative_sd: float | None = None) -> DataFrame:
    """Exact distinct values per column; a sketch when a relative error is given.

    Each column is its own branch of one job: it reads that column alone from a
    columnar source, keeps its type, and combines equal values before the shuffle.
    """
    names = columns or df.columns
    if relative_sd is not None:
        one = df.agg(*[F.approx_count_distinct(_ref(c), relative_sd).alias(f"d{i}") for i, c in enumerate(names)])
        pairs = F.array(
            *[F.struct(F.lit(c).alias("name"), F.col(f"d{i}").alias("nunique")) for i, c in enumerate(names)]
        )
        return one.select(F.inline(pairs))
    return reduce(
        DataFrame.unionByName,
        [
            df.select(_ref(c).alias("value")).where("value is not null").distinct()
            .agg(F.lit(c).alias("name"), F.count(F.lit(1)).alias("nunique"))
            for c in names
        ],
    )


def column_moments(df: DataFrame) -> DataFrame:
    """One row per column: rows, non-null rows, numeric min/max/mean, time min/max, all 1 January."""
    null_d, null_t = F.lit(None).cast("double"), F.lit(None).cast("timestamp")
    aggs: list[Column] = [F.count(F.lit(1)).alias("n_rows")]
    for i, f in enumerate(df.schema.fields):
        col = _ref(f.name)
        numeric, time = is_numeric(f.dataType), is_time(f.dataType)
        num = col.cast("int").cast("double") if isinstance(f.dataType, T.BooleanType) else col
        stamp = col.cast("timestamp") if time else null_t
        new_year = (F.month(stamp) == 1) & (F.dayofmonth(stamp) == 1)
        aggs.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(f.name).alias("name"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.lit(numeric).alias("is_numeric"), F.lit(time).alias("is_time"),
                F.lit(is_nested(f.dataType)).alias("is_nested"),
                F.count(col).alias("non_null"),
                (F.min(num).cast("double") if numeric else null_d).alias("low"),
                (F.max(num).cast("double") if numeric else null_d).alias("high"),
                (F.avg(num).cast("double") if numeric else null_d).alias("mean"),
                F.min(stamp).alias("first_time"), F.max(stamp).alias("last_time"),
                (F.bool_and(new_year) if time else F.lit(None).cast("boolean")).alias("yearly"),
            ).alias(f"c{i}")
        )
    one = df.agg(*aggs)
    return one.select("n_rows", F.inline(F.array(*[F.col(f"c{i}") for i in range(len(df.columns))])))


def kind_rule() -> Column:
    """numeric, categorical, datetime or other, in order of precedence."""
    low = F.lower("name")
    return (
        F.when(F.col("non_null") == 0, "other")
        .when(low.isin(*rules.METADATA_COLUMNS), "other")
        .when(F.col("is_nested"), "other")
        .when(F.col("is_time"), "datetime")
        .when(F.col("is_numeric") & low.isin(*rules.TIME_COLUMNS), "datetime")
        .when(F.col("is_numeric") & (F.col("nunique") > 1), "numeric")
        .when(F.col("is_numeric"), "other")
        .when(low.isin(*rules.GEO_COLUMNS) & (F.col("nunique") >= 2), "categorical")
        .when(F.col("nunique").between(2, 50), "categorical")
        .otherwise("other")
    )


def profile_columns(df: DataFrame, relative_sd: float | None = None) -> DataFrame:
    """position, name, dtype, kind, nunique, null_pct, plus the moments behind the facts."""
    moments = column_moments(df)
    distinct = distinct_counts(df, relative_sd=relative_sd)
    return (
        moments.join(F.broadcast(distinct), "name", "left")  # one row per column
        .withColumn("nunique", F.coalesce("nunique", F.lit(0)).cast("bigint"))
        .withColumn(
            "null_pct",
            F.when(F.col("n_rows") > 0, 100.0 * (F.col("n_rows") - F.col("non_null")) / F.col("n_rows"))
            .otherwise(0.0),
        )
        .withColumn("kind", kind_rule())
    )


def numeric_facts(profile: DataFrame) -> DataFrame:
    return profile.where("kind = 'numeric'").select(
        "name", F.round("low", 4).alias("min"), F.round("high", 4).alias("max"),
        F.round("mean", 4).alias("mean"),
    )


def datetime_facts(profile: DataFrame) -> DataFrame:
    """First and last day, or year when every value is 1 January."""
    def text(c: str) -> Column:
        return F.when(F.col("yearly"), F.year(c).cast("string")).otherwise(F.date_format(c, "yyyy-MM-dd"))

    return profile.where("kind = 'datetime' and first_time is not null").select(
        "position", "name", text("first_time").alias("min"), text("last_time").alias("max")
    )


def time_coverage(profile: DataFrame) -> DataFrame:
    """First datetime column and its range."""
    return datetime_facts(profile).orderBy("position").limit(1).select(
        F.col("name").alias("column"), F.col("min").alias("start"), F.col("max").alias("end")
    )


def categorical_facts(df: DataFrame, columns: list[str], list_max: int = rules.VALUE_LIST_MAX, top: int = 6) -> DataFrame:
    """Trimmed non-empty distinct count, then the sorted list, or the top values when there are many.

    Both windows keep a bounded number of rows per column, so Spark limits them
    per task before the shuffle.
    """
    trimmed = df.select(*[F.nullif(F.trim(_ref(c).cast("string")), F.lit("")).alias(c) for c in columns])
    counts = value_counts(trimmed, columns)
    distinct = counts.groupBy("name").agg(F.count(F.lit(1)).alias("distinct"))
    by_value = W.partitionBy("name").orderBy("value")
    by_count = W.partitionBy("name").orderBy(F.desc("n"), "value")
    listed = (
        counts.withColumn("r", F.row_number().over(by_value)).where(F.col("r") <= list_max)
        .groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("all_values"))
    )
    examples = (
        counts.withColumn("r", F.row_number().over(by_count)).where(F.col("r") <= top)
        .groupBy("name")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda s: s["value"]).alias("top_values"))
    )
    few = F.col("distinct") <= list_max
    return (
        distinct.join(listed, "name").join(examples, "name")
        .select(
            "name", "distinct",
            F.when(few, F.col("all_values")).alias("values"),
            F.when(~few, F.col("top_values")).alias("examples"),
        )
    )


def validate_table(df: DataFrame, min_rows: int = rules.MIN_TABLE_ROWS) -> DataFrame:
    """One row: usable or not, why, row count and column counts by physical type."""
    numeric = sum(1 for f in df.schema.fields if is_numeric(f.dataType) and not isinstance(f.dataType, T.BooleanType))
    text_like = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    categorical = sum(1 for f in df.schema.fields if isinstance(f.dataType, text_like))
    filled = reduce(
        lambda a, b: a + b,
        [F.when(F.count(_ref(c)) > 0, 1).otherwise(0) for c in df.columns], F.lit(0),
    )
    one = df.agg(F.count(F.lit(1)).alias("row_count"), filled.alias("filled"))
    reason = (
        F.when(
            F.col("row_count") < min_rows,
            F.format_string(f"Dataset has only %d row(s) — need at least {min_rows} for analysis", "row_count"),
        )
        .when(F.lit(not df.columns), "Dataset has no columns")
        .when(F.lit(numeric + categorical == 0), "No analyzable columns detected")
        .when(F.col("filled") == 0, "All columns are empty")
        .when(
            F.lit(numeric == 0 and categorical < 2),
            "Need at least one numeric column or two categorical columns for analysis",
        )
        .otherwise("ok")
    )
    out = one.withColumn("reason", reason).withColumn("ok", F.col("reason") == "ok")
    only_text = F.col("reason").startswith("Need at least")
    return out.select(
        "ok", "reason", "row_count",
        F.when(F.col("ok"), numeric).otherwise(0).alias("numeric_columns"),
        F.when(F.col("ok") | only_text, categorical).otherwise(0).alias("categorical_columns"),
    )


def constant_values(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """(name, constant), or that per group of `by`: the single trimmed non-empty value of a column, else null.

    One aggregate for all columns and groups; rows whose group key is null are a group.
    """
    by = by or []
    names = [c for c in (columns or df.columns) if c in df.columns]
    if not names:
        return df.select(*[_ref(c) for c in by]).limit(0).withColumns(
            {"name": F.lit(None).cast("string"), "constant": F.lit(None).cast("string")}
        )
    found = []
    for i, c in enumerate(names):
        text = F.nullif(F.trim(_ref(c).cast("string")), F.lit(""))
        constant = F.when(F.min(text) == F.max(text), F.min(text))
        found.append(F.struct(F.lit(c).alias("name"), constant.alias("constant")).alias(f"__c{i}"))
    grouped = df.groupBy(*[_ref(c) for c in by]) if by else df
    rows = F.array(*[F.col(f"__c{i}") for i in range(len(names))])
    return grouped.agg(*found).select(*[_ref(c) for c in by], F.inline(rows))


def first_constant(names: tuple[str, ...]) -> Column:
    """Aggregate expression over (name, constant) rows: constant of the first listed column that has one."""
    order = F.array(*[F.lit(n) for n in names])
    position = F.array_position(order, F.col("name"))
    usable = (position > 0) & F.col("constant").isNotNull()
    return F.min_by(F.when(usable, F.col("constant")), F.when(usable, position))


def measure_labels(df: DataFrame, columns: list[str], title: str = "") -> DataFrame:
    """What each measure column stands for, from constant indicator columns or the title."""
    meta = constant_values(
        df, [*rules.INDICATOR_COLUMNS, *rules.INDICATOR_ID_COLUMNS, *rules.UNIT_COLUMNS]
    ).agg(
        first_constant(rules.INDICATOR_COLUMNS).alias("indicator"),
        first_constant(rules.INDICATOR_ID_COLUMNS).alias("indicator_id"),
        first_constant(rules.UNIT_COLUMNS).alias("found_unit"),
    )
    names = F.array(*[F.lit(c) for c in columns])
    rows = meta.select(F.explode(names).alias("column"), "*")
    generic = F.lower("column").isin(*rules.MEASURE_COLUMNS)
    catalog = F.nullif(F.lit(title), F.lit(""))
    source = (
        F.when(~generic, "column_name")
        .when(F.col("indicator").isNotNull(), "indicator_column")
        .when(catalog.isNotNull(), "catalog_title")
        .when(F.col("indicator_id").isNotNull(), "indicator_id_column")
        .otherwise("column_name")
    )
    label = (
        F.when(F.col("source") == "indicator_column", F.col("indicator"))
        .when(F.col("source") == "catalog_title", catalog)
        .when(F.col("source") == "indicator_id_column", F.col("indicator_id"))
        .otherwise(F.col("column"))
    )
    disclosure = (
        F.when(
            F.col("source") == "indicator_column",
            F.format_string(
                "The field `%s` holds values for: %s (from indicator metadata in the dataset)", "column", "label"
            ),
        )
        .when(
            F.col("source") == "catalog_title",
            F.format_string("The field `%s` is interpreted as: %s (from catalog title)", "column", "label"),
        )
        .otherwise(F.format_string("The field `%s` is interpreted as: %s", "column", "label"))
    )
    return (
        rows.withColumn("source", source)
        .withColumn("label", label)
        .withColumn("unit", F.when(generic, F.col("found_unit")))
        .withColumn("disclosure", disclosure)
        .withColumn(
            "axis_label",
            F.when(
                F.col("unit").isNotNull() & ~F.col("label").contains(F.col("unit")),
                F.format_string("%s (%s)", "label", "unit"),
            ).otherwise(F.col("label")),
        )
        .select("column", "label", "source", "unit", "disclosure", "axis_label")
    )


# --- driver-side view of a profile (metadata only: one entry per column) ---------


@dataclass
class TableProfile:
    title: str
    resource_id: str
    n_rows: int
    columns: list[dict]
    relevance: dict[str, list[str]] = field(default_factory=dict)

    def of_kind(self, kind: str) -> list[str]:
        """Relevant columns of a kind, or all of that kind when relevance left none."""
        return self.relevance.get(kind) or [c["name"] for c in self.columns if c["kind"] == kind]

    @property
    def is_panel(self) -> bool:
        def has(kind, names):
            return any(c["kind"] == kind and c["name"].lower() in names for c in self.columns)

        timed = any(c["kind"] == "datetime" for c in self.columns)
        return timed and has("numeric", rules.PREFERRED_MEASURE) and has("categorical", rules.GEO_COLUMNS)


def pick_by_name(names: list[str], preferred: tuple[str, ...]) -> str | None:
    """First preferred name that is present, otherwise the first name."""
    for p in preferred:
        if p in names:
            return p
    return names[0] if names else None


def preferred_geo(names: list[str]) -> str | None:
    for p in rules.PREFERRED_GEO:
        if p in names:
            return p
    return next((n for n in names if n.lower() in rules.GEO_COLUMNS), None)


def column_roles(profile: DataFrame) -> DataFrame:
    """(role, name): geo, measure and time column of a table, by ordered name preference."""
    roles = []
    for role, kind, preferred, fallback in (
        ("geo", "categorical", rules.PREFERRED_GEO, F.lower("name").isin(*rules.GEO_COLUMNS)),
        ("measure", "numeric", rules.PREFERRED_MEASURE, F.lit(True)),
        ("time", "datetime", rules.PREFERRED_TIME, F.lit(True)),
    ):
        order = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("name"))
        rank = F.when(order > 0, order).otherwise(F.lit(1000) + F.col("position"))
        roles.append(
            profile.where((F.col("kind") == kind) & ((order > 0) | fallback))
            .select(F.lit(role).alias("role"), "name", rank.alias("rank"))
        )
    every = roles[0].unionByName(roles[1]).unionByName(roles[2])
    first = W.partitionBy("role").orderBy("rank")
    return every.withColumn("r", F.row_number().over(first)).where("r = 1").select("role", "name")
