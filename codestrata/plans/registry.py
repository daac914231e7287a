"""The table of named queries and, where SQL can state them, their oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def stable(df: DataFrame) -> DataFrame:
    """One integer, one float and one text type, so that results compare across engines."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType)):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(key: str, fn: Query, sql: str | None = None) -> None:
    QUERIES[key] = lambda spark, sf_dir: stable(fn(spark, sf_dir))
    if sql is not None:
        ORACLES[key] = sql
