"""Read-only tables over Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Column, TableSchema, Type, from_spark


def external(spark: SparkSession, name: str, path: str, key: str | None = None) -> tuple[TableSchema, DataFrame]:
    """Integers become 64-bit; other types than text and Boolean pass through
    unchanged.  key: a unique column without nulls, if there is one."""
    df = spark.read.parquet(path)
    schema = TableSchema(name, tuple(Column(f.name, from_spark(f.dataType), f.name == key, k) for k, f in enumerate(df.schema.fields)))
    return schema, df.select(*(F.col(f"`{c.name}`").cast("long").alias(c.name) if c.type is Type.INT else F.col(f"`{c.name}`") for c in schema.columns))
