"""Table schemas and the column checks shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, types as T

BAR = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
])

FEATURE = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("ts_available", T.TimestampType()),
    T.StructField("feature_name", T.StringType()),
    T.StructField("feature_value", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_event_id", T.StringType()),
    T.StructField("asof_date", T.TimestampType()),
])

def require_columns(df: DataFrame, names: Iterable[str], what: str = "input") -> DataFrame:
    """Raise ``ValueError`` when a needed column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; it has {df.columns}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project and cast onto a schema, in the schema's column order."""
    require_columns(df, schema.names)
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])
