"""Turn text columns into numbers or times when at least half the rows parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from openstat import rules
from openstat.functions.times import parse_time

_NUMERIC = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
    T.BooleanType,
)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NUMERIC)


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, _TIMES)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StructType, T.ArrayType, T.MapType))


def scalar(name: str, dtype: T.DataType) -> Column:
    """Nested cells become their `value` member, or JSON text."""
    col = F.col(f"`{name}`")
    if isinstance(dtype, T.StructType):
        if "value" in dtype.fieldNames():
            return F.coalesce(col["value"].cast("string"), F.to_json(col))
        return F.to_json(col)
    if is_nested(dtype):
        return F.to_json(col)
    return col


def as_number(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return col.cast("int").cast("double")
    if isinstance(dtype, _TIMES):
        return F.lit(None).cast("double")
    return F.trim(col).try_cast("double") if isinstance(dtype, T.StringType) else col.try_cast("double")


def flatten(df: DataFrame) -> DataFrame:
    if not any(is_nested(f.dataType) for f in df.schema.fields):
        return df
    return df.select(*[scalar(f.name, f.dataType).alias(f.name) for f in df.schema.fields])


def parse_rates(df: DataFrame) -> DataFrame:
    """One row per undecided column: rows, numbers, number range and times that parse."""
    flat = flatten(df)
    undecided = [
        f for f in flat.schema.fields
        if f.name.lower() in rules.TIME_COLUMNS and not is_time(f.dataType)
        or not (is_numeric(f.dataType) or is_time(f.dataType))
    ]
    if not undecided:
        return df.sparkSession.createDataFrame(
            [], "name string, n long, numbers long, low double, high double, times long"
        )
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(undecided):
        col = F.col(f"`{f.name}`")
        number = as_number(col, f.dataType)
        time = parse_time(col) if isinstance(f.dataType, T.StringType) else F.lit(None).cast("timestamp")
        aggs.append(
            F.struct(
                F.lit(f.name).alias("name"),
                F.count(number).alias("numbers"), F.min(number).alias("low"),
                F.max(number).alias("high"), F.count(time).alias("times"),
            ).alias(f"c{i}")
        )
    one = flat.agg(*aggs)
    return one.select(
        "n", F.inline(F.array(*[F.col(f"c{i}") for i in range(len(undecided))]))
    ).select("name", "n", "numbers", "low", "high", "times")


def coerce(df: DataFrame) -> DataFrame:
    """Two passes: one aggregate decides every column, one projection applies it."""
    flat = flatten(df)
    decided = {}
    for r in parse_rates(df).collect():  # one row per column
        floor = max(3, int(r["n"] * 0.5))
        numeric = r["numbers"] >= floor
        year = (
            r["name"].lower() in rules.TIME_COLUMNS and numeric
            and 1800 <= r["low"] and r["high"] <= 2100
        )
        dtype = flat.schema[r["name"]].dataType
        if year:
            decided[r["name"]] = "year"
        elif is_numeric(dtype):
            continue
        elif numeric:
            decided[r["name"]] = "number"
        elif r["times"] >= floor:
            decided[r["name"]] = "time"

    def projected(f: T.StructField) -> Column:
        col, how = F.col(f"`{f.name}`"), decided.get(f.name)
        if how == "year":
            out = F.make_date(F.bround(as_number(col, f.dataType), 0).cast("int"), F.lit(1), F.lit(1))
            out = out.cast("timestamp")
        elif how == "number":
            out = as_number(col, f.dataType)
        elif how == "time":
            out = parse_time(col)
        elif isinstance(f.dataType, T.DecimalType):
            out = col.cast("double")
        else:
            out = col
        return out.alias(f.name)

    return flat.select(*[projected(f) for f in flat.schema.fields])
