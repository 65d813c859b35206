"""Relational operators over DataFrames; each only adds to the logical plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Key = str | tuple[str, bool]


def table_scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan; the listed columns, in that order, are all that is read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def materialized_scan(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def filter_rows(df: DataFrame, predicate: Column | str) -> DataFrame:
    """WHERE and HAVING."""
    return df.filter(predicate)


def project(df: DataFrame, **exprs: Column | str) -> DataFrame:
    return df.select(*[(F.col(e) if isinstance(e, str) else e).alias(name) for name, e in exprs.items()])


def global_aggregate(df: DataFrame, **aggs: Column) -> DataFrame:
    return df.agg(*[a.alias(name) for name, a in aggs.items()])


def group_aggregate(df: DataFrame, keys: Sequence[Column | str], **aggs: Column) -> DataFrame:
    """Keys may be expressions; partial aggregation runs before the shuffle."""
    return df.groupBy(*keys).agg(*[a.alias(name) for name, a in aggs.items()])


def _order(keys: Sequence[Key]) -> list[Column]:
    return [F.col(k).asc() if isinstance(k, str) else F.col(k[0]).asc() if k[1] else F.col(k[0]).desc() for k in keys]


def sort_rows(df: DataFrame, keys: Sequence[Key]) -> DataFrame:
    """Total order; a key is a name or (name, ascending)."""
    return df.orderBy(*_order(keys))


def top_k(df: DataFrame, keys: Sequence[Key], limit: int, offset: int = 0) -> DataFrame:
    """ORDER BY with LIMIT and OFFSET, planned as one TakeOrderedAndProject."""
    ordered = df.orderBy(*_order(keys))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def limit_rows(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def offset_rows(df: DataFrame, n: int) -> DataFrame:
    return df.offset(n)
