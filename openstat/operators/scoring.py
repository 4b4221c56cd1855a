"""Evidence score and assembly of finding rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from openstat.schemas import FINDING


def evidence_score(effect: Column, p: Column) -> Column:
    """Effect times the strength of evidence, or the bare effect when p is missing or zero."""
    strength = F.least(F.lit(20.0), -F.log10(p))
    return F.when(p.isNull() | (p <= 0), F.abs(effect)).otherwise(F.abs(effect) * strength)


def as_findings(df: DataFrame, **cols: Column) -> DataFrame:
    """Project to the finding schema; anything not given is null."""
    out = []
    for f in FINDING.fields:
        given = cols.get(f.name, F.lit(None))
        out.append(given.cast(f.dataType).alias(f.name))
    return df.select(*out)


def empty_findings(spark) -> DataFrame:
    return spark.createDataFrame([], FINDING)
