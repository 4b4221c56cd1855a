"""User-supplied predicates, read-only questions and table listings."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from openstat import rules


#: blank, or only whitelisted characters with none of the blocked words anywhere
_PLAIN_PREDICATE = re.compile(
    rf"(?is)\s*|(?!.*(?:{'|'.join(map(re.escape, rules.FILTER_BLOCKED))}))(?:{rules.FILTER_ALLOWED})"
)
#: one SELECT with neither comments, a second statement, file paths nor a blocked keyword
_PLAIN_SELECT = re.compile(
    rf"(?is)(?!.*\b(?:{'|'.join(rules.SELECT_BLOCKED)})\b)(?!.*(?:--|/\*|\.\s*`))\s*select\b[^;]*[;\s]*"
)


def filter_is_safe(text: str | None) -> bool:
    return _PLAIN_PREDICATE.fullmatch(text or "") is not None


def guarded_filter(df: DataFrame, predicate: str | None) -> DataFrame:
    """Apply a plain comparison predicate; refuse anything else."""
    if not filter_is_safe(predicate):
        raise ValueError("Invalid filter expression")
    return df.where(F.expr(predicate.strip())) if predicate and predicate.strip() else df


def queryable_names(names: list[str]) -> list[str]:
    """Tables a question may read: analysis results first, never raw downloads."""
    allowed = [
        n for n in names
        if not n.startswith("raw_") and n.startswith(("analysis", "cross_measure"))
    ]
    preferred = ("analysis_", "cross_measure_")
    return sorted(allowed, key=lambda n: (not n.startswith(preferred), n))


def ask(tables: dict[str, DataFrame], sql: str, cap: int = rules.QUERY_ROW_CAP) -> DataFrame:
    """Run one read-only SELECT over the whitelisted tables, at most `cap` rows.

    Tables are views only while Spark analyzes the statement, so a name that is
    not one of them fails there. The session's other tables and views, its
    databases and file paths may not be mentioned at all; a statement that
    mentions none of the whitelisted tables is refused too. Every refusal is a
    ValueError.
    """
    if not _PLAIN_SELECT.fullmatch(sql):
        raise ValueError("Only one plain SELECT without comments, paths or forbidden keywords is allowed")
    allowed = queryable_names(list(tables))

    def mentioned(names) -> list[str]:
        return sorted(n for n in names if re.search(rf"(?i)\b{re.escape(n)}\b", sql))

    if not mentioned(allowed):
        raise ValueError("The query must read one of the session tables")
    spark: SparkSession = tables[allowed[0]].sparkSession
    outside = mentioned({x.name for x in spark.catalog.listTables()} - set(allowed)) + [
        x.name for x in spark.catalog.listDatabases() if re.search(rf"(?i)\b{re.escape(x.name)}`?\s*\.", sql)
    ]
    if outside:
        raise ValueError(f"Not allowed: {', '.join(outside)}")
    for name in allowed:
        tables[name].createOrReplaceTempView(name)
    try:
        return spark.sql(re.sub(r"[;\s]+$", "", sql)).limit(cap)
    except AnalysisException as refused:
        raise ValueError(f"Not a question over the session tables: {refused.getCondition()}") from refused
    finally:
        for name in allowed:
            spark.catalog.dropTempView(name)


def describe_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column of each queryable table, with the table's row count."""
    parts = []
    for name in queryable_names(list(tables)):
        df = tables[name]
        columns = F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"), F.lit(f.name).alias("name"),
                    F.lit(f.dataType.simpleString()).alias("type"),
                )
                for i, f in enumerate(df.schema.fields)
            ]
        )
        counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
        parts.append(
            counted.select(F.lit(name).alias("table"), "n_rows", F.inline(columns))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
