"""What the operators of this subpackage share: inputs, scratch tables, Arrow."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here, as a regular-expression class.
WHITE = r"[\x20\x09-\x0D]+"

_own_folder: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Only where that setting is absent on one machine, as in tests, is a local
    folder made; on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
        root = _own_folder[0]
    return f"{root.rstrip('/')}/tessera-{uuid.uuid4().hex}"


#: Spark then drops the shuffle files of a table's making once it is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch, and their number while a table is written: texts are long.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and lost
    executors cost no more than the tasks they ran."""
    spark, folder = df.sparkSession, folder or scratch_folder(df.sparkSession)
    settings = {CLEANUP: "true", BATCH: str(BATCH_ROWS)}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df.write.mode("overwrite").parquet(folder)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(folder)
    out.scratch = folder
    return out


def release(*tables: DataFrame) -> None:
    """Deletes written() tables that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_held: dict[str, Callable[[], object]] = {}
_using = [""]


def hold(kind: str, clear: Callable[[], object]) -> None:
    """Says that this worker goes on with one kind of cache; it is then the
    only one kept, as workers live on from one operator to the next."""
    if _using[0] != kind:
        for other, drop in _held.items():
            if other != kind:
                drop()
        _held[kind], _using[0] = clear, kind


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns alone: null text counts as empty,
    and other columns can't clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of Arrow batches, some at a time as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            yield from zip(*(part.column(c).to_pylist() for c in columns))


class Out:
    """Collects rows and gives them back as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 4096, size: int = 16 << 20):
        self.schema, self.rows, self.size = schema, rows, size
        self.columns: list[list] = [[] for _ in schema]
        self.held = 0

    def add(self, row: tuple, size: int = 0) -> bool:
        """True when a batch should be taken."""
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)
        self.held += size
        return len(self.columns[0]) >= self.rows or self.held >= self.size

    def take(self) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)]
        self.columns, self.held = [[] for _ in self.schema], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield self.take()
