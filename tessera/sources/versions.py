"""Versioned tables: append-only Parquet files, and which of them a snapshot sees.

A version of a row is a row in a file, with the columns named by their ids, so
that adding and dropping columns touches no file, and two more: ``tomb`` (the
row was deleted) and ``seq`` (order of statements inside one commit).  The
commit that added a file gives its versions their timestamp.

A table's files are a base of plain rows, whose keys are all distinct, and
later changes.  Only where changes can hide rows are versions compared: rows of
the base are kept unless a change has their key (an anti join, broadcast while
the changes are small), and of the changes the newest version of each key
counts.  A table that was only inserted into is a plain scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TableSchema, Value

TOMB, SEQ, TS = "tomb", "seq", "ts"


@dataclass(frozen=True)
class File:
    """ts: the commit; fresh: rows of keys that had no version before; base: a
    whole snapshot, before which nothing needs to be read."""

    path: str
    ts: int
    fresh: bool = False
    base: bool = False
    rows: int = -1


def stored(schema: TableSchema) -> T.StructType:
    fields = [T.StructField(f"c{c.id}", c.type.spark) for c in schema.columns]
    return T.StructType([*fields, T.StructField(TOMB, T.BooleanType()), T.StructField(SEQ, T.LongType())])


def read_files(spark: SparkSession, schema: TableSchema, files: Sequence[File]) -> DataFrame | None:
    """All versions in the files with their timestamps; a column that a file
    doesn't have is of its default."""
    by_ts: dict[int, list[str]] = {}
    for f in files:
        by_ts.setdefault(f.ts, []).append(f.path)
    parts = [spark.read.schema(stored(schema)).parquet(*paths).withColumn(TS, F.lit(ts)) for ts, paths in by_ts.items()]
    if not parts:
        return None
    return _defaults(reduce(DataFrame.unionByName, parts), schema)


def _defaults(df: DataFrame, schema: TableSchema) -> DataFrame:
    filled = [F.coalesce(F.col(f"c{c.id}"), F.lit(c.default)).alias(f"c{c.id}") if c.default is not None else F.col(f"c{c.id}") for c in schema.columns]
    return df.select(*filled, TOMB, SEQ, TS)


def plain(spark: SparkSession, schema: TableSchema, files: Sequence[File]) -> DataFrame | None:
    """Rows of files that hide nothing: one scan, whatever the commits were."""
    if not files:
        return None
    df = spark.read.schema(stored(schema)).parquet(*(f.path for f in files)).withColumn(TS, F.lit(0).cast("long"))
    return _defaults(df, schema)


def buffered(spark: SparkSession, schema: TableSchema, rows: Sequence[tuple[tuple[Value, ...], bool, int]], ts: int) -> DataFrame:
    """Versions that a transaction holds in memory."""
    kind = stored(schema)
    return spark.createDataFrame([(*row, tomb, seq) for row, tomb, seq in rows], kind).withColumn(TS, F.lit(ts))


def newest(versions: DataFrame, key: str) -> DataFrame:
    """The newest version of each key, tombstones too.  An aggregate of one value
    a column: it combines before the shuffle, so a key with very many versions
    meets as one row a task; Catalyst prunes the columns that aren't read and
    pushes predicates on the key through it."""
    last = F.struct(TS, SEQ)
    found = versions.groupBy(key).agg(*(F.max_by(c, last).alias(c) for c in versions.columns if c != key))
    return found.select(versions.columns)


def snapshot(spark: SparkSession, schema: TableSchema, files: Sequence[File], own: DataFrame | None = None) -> DataFrame:
    """The visible rows, columns in schema order under their names.

    files: those the snapshot may see, in order of commit.  own: versions that
    the reading transaction wrote, with a timestamp above all others."""
    start = max((k for k, f in enumerate(files) if f.base), default=0)
    files = files[start:]
    cut = next((k for k, f in enumerate(files) if not f.fresh and not f.base), len(files))
    base, changes = plain(spark, schema, files[:cut]), read_files(spark, schema, files[cut:])
    if own is not None:
        changes = own if changes is None else changes.unionByName(own)
    key = f"c{schema.key.id}"
    if changes is not None:
        live = newest(changes, key).where(~F.col(TOMB))
        if base is not None:
            live = base.join(changes.select(key).distinct(), key, "left_anti").select(live.columns).unionByName(live)
    elif base is not None:
        live = base
    else:
        live = spark.createDataFrame([], stored(schema))
    return live.select(*(F.col(f"c{c.id}").alias(f"v{k}") for k, c in enumerate(schema.columns))).toDF(*(c.name for c in schema.columns))
