"""The operators of a query plan: each takes DataFrames and gives one.

Columns have internal names that are unique in a plan, so labels may repeat and
differ by case alone.  What Catalyst does on its own is left to it: partial
aggregation, choice of join, top-k from sort and limit, pruning and push-down.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seq_scan(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """All rows, columns renamed in order."""
    return table.toDF(*names)


def point_get(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def range_scan(df: DataFrame, key: str, start=None, end=None) -> DataFrame:
    """Keys in [start, end); None is unbounded."""
    if start is not None:
        df = df.where(F.col(key) >= F.lit(start))
    return df if end is None else df.where(F.col(key) < F.lit(end))


def filtered(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def projected(df: DataFrame, columns: Sequence[tuple[str, Column]]) -> DataFrame:
    return df.select(*(c.alias(name) for name, c in columns))


def inner_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "inner")


def hash_aggregate(df: DataFrame, keys: Sequence[str], aggregates: Sequence[tuple[str, Column]]) -> DataFrame:
    """Without keys one row, on empty input too; without aggregates the distinct keys."""
    outs = [c.alias(name) for name, c in aggregates]
    if not keys:
        return df.agg(*outs)
    return df.groupBy(*keys).agg(*outs) if outs else df.select(*keys).distinct()


def ordered(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """Nulls come last ascending and first descending."""
    return df.orderBy(*(F.col(n).asc_nulls_last() if up else F.col(n).desc_nulls_first() for n, up in keys))


def limited(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)
