"""Fixed row shapes shared by the operators."""

from pyspark.sql import types as T

PROFILE = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("nunique", T.LongType()),
        T.StructField("null_pct", T.DoubleType()),
    ]
)

FINDING = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("value", T.DoubleType()),
        T.StructField("p_value", T.DoubleType()),
        T.StructField("n", T.LongType()),
        T.StructField("method", T.StringType()),
        T.StructField("caveat", T.StringType()),
        T.StructField("sql", T.StringType()),
        T.StructField("datasets", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
        T.StructField("details", T.StringType()),
    ]
)
